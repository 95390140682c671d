"""Scoring of whole documents by a gated recurrent language model, trained here, and by the counts of words beside it.

Tokens are lower-cased runs without white space and one end. Every training token is counted: tasks send counts of their words, 16 bytes each, and the table of counts stays distributed. Its most frequent
words, no more than ``TABLE``, go to the tasks by broadcast; what a document holds besides them is joined with the table. So counts are exact for any vocabulary, and no key that is joined is frequent in training.

The model (``gru``) knows the most frequent words, below ``gru.WORDS``. Any other belongs to a class by its shape, that is by its last bytes and its accents, and its probability within the class comes
from the counts; so the model's score is one of the text, too, not of a text with words left out.

Training is data-parallel: in each of ``ROUNDS`` rounds every task trains from the same parameters on its documents of that round, a share of 1 in ``SHARES`` by a hash of doc_id, and the parameters become the
mean over the tasks, weighted by their tokens. As many shares as rounds: every training document is learnt from, once. Blocks of parameters are added up by tasks, so that the driver
gets one model. Scoring passes each text once; the state is carried from window to window.

Nulls: a null text is empty and has one token, the end. A null doc_id isn't held out, and its rows are trained on together. Repeated rows count and are scored each. Without training texts N and V are 0 and the base score is 0 for
each token. An empty table gives an empty result. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import gru, textpack
from ledgerlark.llm.shared import parallelism, written

FOLDS, HELD_OUT = 5, 1
#: Most words of the broadcast table; 18 bytes each.
TABLE = 1 << 19
SHARES, ROUNDS, BLOCKS, SEED = 2, 2, 32, 13
#: Bytes of text handled at once, and distinct words that a task holds before it sends them.
CHUNK, HELD = 4 << 20, 1 << 20
END = 0
U64 = np.uint64
_INDEX = 19


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, first) of a chunk's words, without ends. A shape is one of ``gru.OTHERS``: 8 kinds of accents by 8 of endings."""
    hashes, starts, ends, first = textpack.words(data, offsets, textpack.SPACED)
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), first
    low, most = textpack.LOWER[data], np.maximum.reduceat(data, starts)
    accent = np.where(most < 128, 0, 1 + most % 7).astype(np.int64)
    ending = low[ends - 1].astype(np.int64)
    for i in (2, 3):
        ending = ending * 31 + np.where(ends - i >= starts, low[np.maximum(ends - i, 0)], 0)
    return hashes, accent * 8 + ((ending * 0x9E3779B1) >> 7) % 8, first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    docs, size = 0, 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, shape, n = (np.concatenate(x) for x in zip(*held))
        word, at, to = np.unique(word, return_index=True, return_inverse=True)
        return word, shape[at], np.bincount(to, n, minlength=len(word)).astype(np.int64)

    def batch() -> pa.RecordBatch:
        word, shape, n = merged()
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(shape), pa.array(n)], names=["word", "shape", "n"])

    for b in batches:
        docs += b.num_rows
        for _, _, data, offsets in textpack.chunks(b.column(0), CHUNK):
            word, shape, _ = tokens(data, offsets)
            word, at, n = np.unique(word, return_index=True, return_counts=True)
            held.append((word, shape[at], n))
            size += len(word)
            if size > HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield batch()
                    held, size = [], 0
    if docs:
        held.append((np.array([END], U64), np.zeros(1, np.int64), np.array([docs])))
        yield batch()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, shape, n: how often each word and the end occur in the training texts, as a written table."""
    own = docs.filter(~held_out(F.col("doc_id"))).select("text").mapInArrow(_counted, "word long, shape long, n long")
    return written(own.groupBy("word").agg(F.max("shape").alias("shape"), F.sum("n").alias("n")), "counts")


class Vocabulary:
    """The most frequent words by hash, their counts and the model's numbers; sums over all words."""

    def __init__(self, counts: DataFrame):
        """Of ``counts`` only sums and no more than ``TABLE`` words come to the driver: words from a count upwards, found by a histogram of the logarithms of counts."""
        level = F.floor(16 * F.log2("n"))
        levels = sorted(counts.filter(F.col("word") != END).groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")).collect(), reverse=True)
        ends = counts.filter(F.col("word") == END).first()
        self.docs = ends["n"] if ends else 0
        self.tokens = sum(r["n"] for r in levels) + self.docs
        self.distinct = sum(r["words"] for r in levels) + (self.docs > 0)

        def least(most: int) -> int:
            total, found = 0, 1 << 62
            for r in levels:
                total += r["words"]
                if total > most:
                    break
                found = r["least"]
            return found

        met = least(TABLE)
        known = max(least(gru.WORDS - 1), met)
        table = counts.filter((F.col("word") != END) & (F.col("n") >= met)).select("word", "n").toArrow()
        keys, n = table["word"].to_numpy().view(U64), table["n"].to_numpy()
        keys, n = np.append(keys, U64(END)), np.append(n, self.docs)
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order]
        self.number = np.full(len(keys), -1, dtype=np.int16)
        mine = np.flatnonzero((self.n >= known) & (self.keys != END))
        mine = mine[np.lexsort((self.keys[mine], -self.n[mine]))]
        self.number[mine] = np.arange(1, len(mine) + 1)
        self.number[np.searchsorted(self.keys, U64(END))] = 0
        others = counts.filter((F.col("word") != END) & (F.col("n") < known)).groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
        self.other_n, self.other_words = np.zeros(gru.OTHERS), np.zeros(gru.OTHERS)
        for r in others:
            self.other_n[r["shape"]], self.other_words[r["shape"]] = r["n"], r["words"]
        self._ready = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def initial(self) -> np.ndarray:
        counts = np.full(gru.WORDS, -1.0)
        counts[self.number[self.number >= 0]] = self.n[self.number >= 0]
        return gru.initial(counts, self.other_n)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the table, -1 if it isn't there: by its upper bits, then along the few words that share them."""
        if self._ready is None:
            self._ready = np.searchsorted(self.keys, np.arange(1 << _INDEX, dtype=U64) << U64(64 - _INDEX)), np.log10(self.n + 0.5), np.log10(self.other_n + 0.5 * (self.other_words + 1))
        at = self._ready[0][(hashes >> U64(64 - _INDEX)).astype(np.int64)]
        open_ = np.arange(len(hashes))
        last = len(self.keys) - 1
        while len(open_):
            here = np.minimum(at[open_], last)
            on = (self.keys[here] < hashes[open_]) & (at[open_] < last)
            open_ = open_[on]
            at[open_] += 1
        at = np.minimum(at, last)
        return np.where(self.keys[at] == hashes, at, -1)

    @property
    def logs(self) -> np.ndarray:
        return self._ready[1]

    @property
    def other_logs(self) -> np.ndarray:
        return self._ready[2]

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(number, first, hash, place, shape) of a chunk's tokens, ends included: the model's numbers of all texts, and where each text's begin."""
        hashes, shape, first = tokens(data, offsets)
        ends = first[1:]
        hashes, shape = np.insert(hashes, ends, U64(END)), np.insert(shape, ends, 0)
        first = first + np.arange(len(first))
        place = self.find(hashes)
        number = np.where(place >= 0, self.number[place], -1).astype(np.int64)
        return np.where(number >= 0, number, gru.WORDS + shape), first, hashes, place, shape


def trained(docs: DataFrame, vocabulary: Vocabulary, shares: int = SHARES, rounds: int = ROUNDS) -> np.ndarray:
    """The model's parameters after ``rounds`` rounds, each on another 1 of ``shares`` of the training documents."""
    spark, flat = docs.sparkSession, vocabulary.initial()
    cuts = [gru.SIZE * i // BLOCKS for i in range(BLOCKS + 1)]
    shared = spark.sparkContext.broadcast(vocabulary)
    names = ["block", "words", "values"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, words, values in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(block, [0.0, 0.0])
                own[0] += words
                own[1] = own[1] + np.frombuffer(values, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x[0] for x in held.values()], pa.float64()), pa.array([x[1].tobytes() for x in held.values()], pa.binary())], names=names)

    for r in range(rounds):
        start = spark.sparkContext.broadcast(flat)

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            trainer = gru.Trainer(start.value)
            for batch in batches:
                for _, _, data, offsets in textpack.chunks(batch.column(0), CHUNK):
                    number, first, *_ = shared.value.encoded(data, offsets)
                    trainer.learn(number, first)
            if trainer.words:
                out = trainer.flat.astype(np.float64) * trainer.words
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([float(trainer.words)] * BLOCKS), pa.array([out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=names)

        own = docs.filter(~held_out(F.col("doc_id")) & (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(shares)) == r)).select("text")
        learnt = own.mapInArrow(learn, "block int, words double, values binary")
        means = learnt.repartition(min(BLOCKS, parallelism(spark)), "block").mapInArrow(sums, "block int, words double, values binary").collect()
        if means:
            flat = np.concatenate([np.frombuffer(x["values"], np.float64) / x["words"] for x in sorted(means, key=lambda x: x["block"])]).astype(np.float32)
    return flat


SCORED = "doc_id long, n_tokens long, n_known long, base double, model double, rest array<struct<word: long, n: long>>"


def _scored(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray) -> DataFrame:
    """For each row of docs the sums over the words of the broadcast table, and the other words with how often each occurs."""
    spark = docs.sparkSession
    shared, model = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = shared.value, gru.views(model.value)
        for batch in batches:
            for a, b, data, offsets in textpack.chunks(batch.column(1), CHUNK):
                number, first, hashes, place, shape = v.encoded(data, offsets)
                text, found, other = textpack.per_text(first), place >= 0, number >= gru.WORDS
                logs = np.where(found, v.logs[place], 0.0)
                base = np.bincount(text, logs, minlength=b - a)
                within = np.bincount(text[other], logs[other] - v.other_logs[shape[other]], minlength=b - a)
                known = np.bincount(text[found & (v.n[place] > 0)], minlength=b - a)
                at = np.flatnonzero(~found)
                at = at[np.lexsort((hashes[at], text[at]))]
                heads = np.flatnonzero(np.concatenate(([True], (text[at][1:] != text[at][:-1]) | (hashes[at][1:] != hashes[at][:-1])))) if len(at) else at
                rest = pa.StructArray.from_arrays([pa.array(hashes[at[heads]].view(np.int64)), pa.array(np.diff(np.append(heads, len(at))).astype(np.int64))], names=["word", "n"])
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[at[heads]], np.arange(b - a + 1)), pa.int32()), rest)
                score = gru.log10_probabilities(p, number, first) + within
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), rest]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base", "model", "rest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def score_documents(docs: DataFrame, train_on: DataFrame | None = None, shares: int = SHARES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``. The model is learnt from the rows of ``train_on`` (by default ``docs``) that aren't held out."""
    source = docs if train_on is None else train_on
    counts = word_counts(source)
    vocabulary = Vocabulary(counts)
    flat = trained(source, vocabulary, shares, rounds)
    scored = written(_scored(docs, vocabulary, flat).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode("rest").alias("x")).select("row", "x.*")
    c = F.coalesce("c", F.lit(0))
    met = rest.join(counts.select("word", F.col("n").alias("c")), "word", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("met"))
    more, log_all = F.coalesce("more", F.lit(0.0)), float(np.log10(vocabulary.tokens + 0.5 * (vocabulary.distinct + 1)))
    return scored.drop("rest").join(met, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (F.col("model") + more).alias("score"),
    )
