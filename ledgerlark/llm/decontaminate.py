"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents (a fixed-size table of buckets).
2. The latent space of TF-IDF passages, the matrix of which has all windows of ``WINDOW`` words of every document, end to end, and all passages of the benchmark as its rows: the subspace iteration (randomised SVD) starts from the
   benchmark's passages and then goes through the whole matrix once; what it spans is turned to its leading directions (Nyström). The rows are never collected: each product with the matrix is a pass over the texts that
   adds up partial sums of a fixed size, ``FEATURES`` hashed words by ``DIMS`` dimensions. One space serves every block of the benchmark.
3. All windows of ``WINDOW`` words of every document, ``STRIDE`` apart, are folded into that space, and candidates are those with a cosine (of the projections) of at
   least ``NEAR`` to a passage. A window whose words, each with the largest weight it has in any passage, don't add up to ``SHARED`` of its length isn't folded.
   Candidates by words join them, so that nothing the check takes is lost: every span in which a leak
   of step 4 can lie, by ``VERBATIM`` or, in texts that also hold enough of the answer's words, by ``PARAPHRASE``. By prefix: if a passage's most frequent words, left out, number k fewer than a leak must hold, its span holds k of the others.
4. Candidates are verified by longest common subsequences of words: a leak has at least ``VERBATIM`` of the passage's words in order,
   or ``PARAPHRASE`` of them with at least ``ANSWER`` of the answer's. The answer is the benchmark's column ``answer``, or else the passage's last
   sentence.

The benchmark is a stated query set: its different texts are searched in blocks of about ``QUERIES`` passages, so what is broadcast has a bound; a block's tables are freed before the next
one's are built. Documents never move.

Words are runs of letters and digits, lower-cased in ASCII. Nulls: a null or empty text on either side has no window and no leak; a null doc_id
is kept. Repeated documents are reported each, repeated benchmark items once for each item_id. Passages of fewer than ``LEAST`` words must stand
word for word; those of fewer than ``SHORTEST`` are too short to tell and aren't searched. Empty tables give an empty result. Columns besides doc_id and text, and item_id, text and answer, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import textpack
from ledgerlark.llm.shared import parallelism, written

BUCKETS, SLICES = 1 << 22, 64
WINDOW, STRIDE, NEAR, SHARED = 48, 16, 0.7, 0.35
#: Of the latent space: hashed words, dimensions, further ones while it is fitted, rounds over the benchmark's passages.
FEATURES, DIMS, OVER, ROUNDS = 1 << 14, 64, 8, 2
#: Slices in which partial sums travel, and tasks that make them at most, unless more run at once.
PARTS, SUMS = 16, 64
#: Rows that are multiplied at once, and in one of how many of them a feature stands at least to have a column of its own then.
ROWS, OFTEN = 4096, 48
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.5, 0.8
#: Words of a benchmark passage at most (longer items are cut, half overlapping), at least for other than equal words, and at least.
LONGEST, LEAST, SHORTEST = 64, 6, 4
#: Words of a passage, besides the frequent ones, that a candidate by words holds at least.
HELD = 3
#: Words that expand into passages at once, at most, unless they are one text's.
EXPANDED = 1 << 22
#: Passages searched in one pass over the documents, unless one item has more.
QUERIES = 4096
SHIFT = np.uint64(42)
U64 = np.uint64

#: 1: letters, digits and all beyond ASCII.
LETTERS = (textpack.TYPED == 1).astype(np.uint8)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, first = textpack.words(data, offsets, LETTERS)
    return hashes, first


def _text_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return _words(data, np.array([0, len(data)]))[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the task's documents each bucket occurs, as compressed slices; slice -1 holds the numbers of documents and of windows."""
    counts, docs, windows, held, n_held = np.zeros(BUCKETS, dtype=np.int64), 0, 0, [], 0
    for batch in batches:
        docs += batch.num_rows
        for a, b, data, offsets in textpack.chunks(batch.column(0)):
            hashes, first = _words(data, offsets)
            at = (hashes >> SHIFT).astype(np.int64)
            windows += int((-(-np.diff(first) // WINDOW)).sum())
            held.append(np.unique(textpack.per_text(first) * BUCKETS + at) % BUCKETS)
            n_held += len(held[-1])
            if n_held > 1 << 20:
                counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held, n_held = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
    from pyspark import TaskContext

    task, part = TaskContext.get().partitionId(), BUCKETS // SLICES
    slices = [(-1, np.array([docs, windows], dtype="<u4"))] + [(i, counts[i * part : (i + 1) * part].astype("<u4")) for i in range(SLICES)]
    for i, own in slices:
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task % 16], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["slice", "task", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = key = None
    for batch in batches:
        key = batch.column(0)[0].as_py()
        for packed in batch.column(2).to_pylist():
            own = np.frombuffer(zlib.decompress(packed), dtype="<u4").astype(np.int64)
            total = own if total is None else total + own
    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)], pa.binary())], names=["slice", "task", "counts"])


def weights(docs: DataFrame) -> np.ndarray:
    return measured(docs)[0]


def measured(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequency of each bucket, in sixteenths, over all documents (BUCKETS bytes at any input size), and the number of windows end to end."""
    schema = "slice int, task int, counts binary"
    sums = docs.select("text").mapInArrow(_count, schema).groupBy("slice", "task").applyInArrow(_added, schema)
    packed = {r["slice"]: r["counts"] for r in sums.select("slice", F.lit(0).alias("task"), "counts").groupBy("slice", "task").applyInArrow(_added, schema).collect()}
    own = lambda i: np.frombuffer(zlib.decompress(packed[i]), dtype="<u4") if i in packed else np.zeros(1, "<u4")
    n, windows, part = int(own(-1)[0]), int(own(-1)[-1]), BUCKETS // SLICES
    idf = np.empty(BUCKETS, dtype=np.uint8)
    for i in range(SLICES):
        idf[i * part : (i + 1) * part] = np.clip(np.round(16 * np.log((n + 1) / (own(i) + 1.0))), 0, 255)
    return idf, windows


IDF = (np.arange(256) / 16).astype(np.float32)


@dataclass
class Passage:
    item_id: int  # or the key of its text
    words: np.ndarray
    answer: np.ndarray


def passages(rows: list[tuple[int, str | None, str | None]]) -> list[Passage]:
    out = []
    for item, text, answer in rows:
        own = _text_words(text)
        last = [s for s in (text or "").replace("\n", ". ").split(". ") if len(_text_words(s)) >= 3]
        given = _text_words(answer) if answer else _text_words(last[-1]) if last else own[-5:]
        cuts = [own] if len(own) <= LONGEST else [own[i : i + LONGEST] for i in range(0, len(own) - LONGEST // 2, LONGEST // 2)]
        out += [Passage(item, c, given) for c in cuts if len(c) >= SHORTEST]
    return out


def _rows(found: list[Passage], buckets: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, unit-length weight) of each passage's buckets, given the benchmark's buckets in order and their weights."""
    out = []
    for p in found:
        at, n = np.unique((p.words >> SHIFT).astype(np.int64), return_counts=True)
        place = np.searchsorted(buckets, at)
        w = n * IDF[idf[place]]
        out.append((1 + place, w / max(float(np.sqrt((w * w).sum())), 1e-9)))
    return out


def vector(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, unit-length weight) of a run of words."""
    at, n = np.unique((words >> SHIFT).astype(np.int64), return_counts=True)
    w = n * IDF[idf[at]]
    feature, place = np.unique(at * FEATURES // BUCKETS, return_inverse=True)
    w = np.bincount(place, weights=w, minlength=len(feature))
    return feature, (w / max(float(np.sqrt((w * w).sum())), 1e-9)).astype(np.float32)


VECTORS = "at binary, w binary"


def _packed(vectors: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes() for at, _ in vectors], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in vectors], pa.binary())], names=["at", "w"])


def _windows(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each window, feature, unit-length weight) of all windows of a chunk of texts, end to end: ``vector`` of each of them, for all at once."""
    hashes, first = _words(data, offsets)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    many = -(-np.diff(first) // WINDOW)
    begin = np.repeat(first[:-1], many) + WINDOW * (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
    size = np.diff(np.append(begin, len(hashes)))
    key, n = np.unique(np.repeat(np.arange(len(begin)), size) * BUCKETS + (hashes >> SHIFT).astype(np.int64), return_counts=True)
    at = key % BUCKETS
    place = key // BUCKETS * FEATURES + at * FEATURES // BUCKETS
    heads = np.flatnonzero(np.diff(place, prepend=-1))
    w, place = np.add.reduceat(n * IDF[idf[at]], heads), place[heads]
    own = place // FEATURES
    w /= np.maximum(np.sqrt(np.add.reduceat(w * w, np.searchsorted(own, np.arange(len(begin))))), 1e-9)[own]
    return np.bincount(own, minlength=len(begin)), (place % FEATURES).astype(np.int32), w.astype(np.float32)


def asked_vectors(items: DataFrame, idf: np.ndarray) -> DataFrame:
    """(at, w) of all passages of the benchmark."""
    shared = items.sparkSession.sparkContext.broadcast(idf)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = passages(list(zip(*(c.to_pylist() for c in batch.columns))))
            if found:
                yield _packed([vector(p.words, shared.value) for p in found])

    rows = items.select("key", "text", "answer").mapInArrow(asked, VECTORS)
    out = written(rows.repartition(min(8, parallelism(items.sparkSession))), "vectors")
    shared.destroy()
    return out


def passage_vectors(docs: DataFrame, items: DataFrame, idf: np.ndarray, windows: int = 0) -> DataFrame:
    """The rows of the matrix (at, w), to look at: all windows of the corpus, end to end, and all passages of the benchmark. The space is fitted without writing them."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in textpack.chunks(batch.column(0)):
                n, at, w = _windows(data, offsets, shared.value)
                cuts = np.cumsum(n)[:-1]
                if len(n):
                    yield _packed(list(zip(np.split(at, cuts), np.split(w, cuts))))

    return docs.select("text").mapInArrow(run, VECTORS).unionByName(asked_vectors(items, idf))


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of a batch (at, w), as ``_windows`` gives them."""
    ats, ws = ([np.frombuffer(x, kind) for x in batch.column(i).to_pylist()] for i, kind in ((0, "<i4"), (1, "<f4")))
    if ats:
        yield np.array([len(x) for x in ats]), np.concatenate(ats), np.concatenate(ws)


def _ranked(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of ``n`` neighbours each, the largest first: their numbers, where each begins, and how many have a first, a second, ... member."""
    order = np.argsort(-n, kind="stable")
    return order, (np.cumsum(n) - n)[order], np.searchsorted(-n[order], -np.arange(1, int(n.max(initial=0)) + 1), "right")


def _added_products(total: np.ndarray, table: np.ndarray, n: np.ndarray, at: np.ndarray, w: np.ndarray) -> None:
    """Adds A'A times ``table`` to ``total`` for the rows A (features of each, feature, weight). Features that many of the rows have go through dense products, the others member by member over all rows, then over all features."""
    ends = np.concatenate(([0], np.cumsum(n)))
    for a in range(0, len(n), ROWS):
        b = min(len(n), a + ROWS)
        own, weight, row = at[ends[a] : ends[b]], w[ends[a] : ends[b]], np.repeat(np.arange(b - a), n[a:b])
        count = np.bincount(own, minlength=len(table))
        often = np.flatnonzero(count * OFTEN > b - a)
        column = np.full(len(table), -1)
        column[often] = np.arange(len(often))
        column = column[own]
        rare = column < 0
        dense = np.zeros((b - a, len(often)), dtype=np.float32)
        dense[row[~rare], column[~rare]] = weight[~rare]
        folded = dense @ table[often]
        own, weight, row = own[rare], weight[rare][:, None], row[rare]
        order, first, members = _ranked(np.bincount(row, minlength=b - a))
        sums = np.zeros_like(folded)
        for k, to in enumerate(members):
            sums[:to] += table[own[first[:to] + k]] * weight[first[:to] + k]
        folded[order] += sums
        total[often] += dense.T @ folded
        by = np.argsort(own.astype(np.uint16) if len(table) <= 1 << 16 else own, kind="stable")
        weight, row = weight[by], row[by]
        count[often] = 0
        used = np.flatnonzero(count)
        order, first, members = _ranked(count[used])
        sums = np.zeros((len(used), table.shape[1]), dtype=np.float32)
        for k, to in enumerate(members):
            sums[:to] += folded[row[first[:to] + k]] * weight[first[:to] + k]
        total[used[order]] += sums


def product(rows: DataFrame, table: np.ndarray, read: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]] = _unpacked) -> np.ndarray:
    """A'A times ``table``, A being what ``read`` makes of the distributed rows: each task adds up its part, and the parts are added slice by slice."""
    shared = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32))
    width, part = table.shape[1], -(-table.shape[0] // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        total = np.zeros(table.shape, dtype=np.float32)
        for batch in batches:
            for n, at, w in read(batch):
                _added_products(total, table, n, at, w)
        for i in range(PARTS):
            own = total[i * part : (i + 1) * part]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "sum"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = key = None
        for batch in batches:
            key = batch.column(0)[0].as_py()
            for own in batch.column(1).to_pylist():
                own = np.frombuffer(own, np.float32).astype(np.float64)
                total = own if total is None else total + own
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part", "sum"])

    schema, out = "part int, sum binary", np.zeros(table.shape, dtype=np.float32)
    for r in rows.mapInArrow(run, schema).groupBy("part").applyInArrow(added, schema).collect():
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["sum"], np.float32).reshape(-1, width)
    shared.destroy()
    return out


def text_product(docs: DataFrame, table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The same, A being all windows of all documents. The sums that the tasks send don't grow with the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _, _, data, offsets in textpack.chunks(batch.column(0)):
            yield _windows(data, offsets, shared.value)

    out = product(docs.select("text").coalesce(max(SUMS, parallelism(docs.sparkSession))), table, read)
    shared.destroy()
    return out


def fitted_space(docs: DataFrame, items: DataFrame, idf: np.ndarray) -> np.ndarray:
    """(feature, dimension) of the whole matrix, started from the benchmark's passages."""
    asked = asked_vectors(items, idf)
    start = np.linalg.qr(latent_space(asked, dims=DIMS + OVER))[0]
    return leading(start, text_product(docs, start, idf) + product(asked, start), DIMS)


def leading(start: np.ndarray, image: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of A as far as A'A times ``start``, the image, tells them (Nyström); columns of zeros where it spans less."""
    values, turn = np.linalg.eigh((start.T @ image + image.T @ start).astype(np.float64) / 2)
    keep = values > 1e-6 * values.max(initial=0)
    half = image @ (turn[:, keep] / np.sqrt(values[keep]))
    values, turn = np.linalg.eigh(half.T @ half)
    order = [i for i in np.argsort(values)[::-1][:rank] if values[i] > 1e-9]
    out = np.zeros((len(start), rank), dtype=np.float32)
    out[:, : len(order)] = half @ (turn[:, order] / np.sqrt(values[order]))
    return out


def latent_space(rows: DataFrame, features: int = 0, dims: int = DIMS) -> np.ndarray:
    """(feature, dimension): the leading right singular vectors of the distributed rows."""
    space, _ = randomised_svd(lambda x: product(rows, x), features or FEATURES, dims)
    return space.astype(np.float32)


def randomised_svd(multiply, size: int, rank: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(V, singular values): the leading right singular vectors of A, given X -> A'A X."""
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(size, rank + OVER)), dtype=np.float32))[0]
    for _ in range(ROUNDS):
        basis = np.linalg.qr(multiply(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ multiply(basis))
    order = np.argsort(values)[::-1][:rank]
    return basis @ turn[:, order], np.sqrt(np.maximum(values[order], 0))


@dataclass
class Windows:
    """The words of a chunk of texts, in blocks of STRIDE words, none across texts; a window is three of them."""

    weight: np.ndarray
    row: np.ndarray  # in the block's table
    feature: np.ndarray  # in the latent space
    begin: np.ndarray  # of each block: its first word
    stop: np.ndarray  # of each block: the first word of the next one, then the end
    left: np.ndarray  # blocks of the window that begins here
    starts: np.ndarray  # whether a window begins here
    square: np.ndarray  # of the window that begins here: the sum of its squared weights

    def sums(self, each: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(np.add.reduceat(each, self.begin), dtype=np.float64)))
        here = np.arange(len(self.begin))
        return total[here + self.left] - total[here]


@dataclass
class Runs:
    """For each passage, a set of words (rows of the block) of which ``need`` stand within ``span`` words of a text wherever the text can hold it."""

    first: np.ndarray  # row of the block -> where its passages begin in owner
    owner: np.ndarray
    need: np.ndarray
    span: np.ndarray

    @staticmethod
    def of(wanted: list[tuple[np.ndarray, int, int, int]], row_of: np.ndarray, idf: np.ndarray) -> Runs:
        """``wanted``: of each passage, words, how many of them in order make a leak, within how many words, and how many to ask for at least."""
        rows, owner, need = [], [], []
        for i, (words, least, _, held) in enumerate(wanted):
            at, n = np.unique((words >> SHIFT).astype(np.int64), return_counts=True)
            common = np.lexsort((at, idf[at]))
            total = np.cumsum(n[common])
            out = int(np.searchsorted(total, least - min(least, held), "right"))
            need.append(least - (int(total[out - 1]) if out else 0))
            rows.append(row_of[at[common[out:]]])
            owner.append(np.full(len(at) - out, i, dtype=np.uint16 if len(wanted) < 1 << 16 else np.int64))
        row = np.concatenate(rows)
        first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=int(row_of.max()) + 1))))
        return Runs(first, np.concatenate(owner)[np.argsort(row, kind="stable")], np.array(need), np.array([span for _, _, span, _ in wanted]))

    def candidates(self, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, passage, lo, hi): the words lo to hi of the text hold all spans around one run of the passage's words."""
        count = self.first[row + 1] - self.first[row]
        ends = np.concatenate(([0], np.cumsum(count)))[first]
        out, a = [], 0
        while a < len(first) - 1:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + EXPANDED, "right")) - 1)
            n = count[first[a] : first[b]]
            token = np.repeat(np.arange(first[a], first[b]), n)
            owner = self.owner[np.repeat(self.first[row[first[a] : first[b]]] - (np.cumsum(n) - n), n) + np.arange(len(token))]
            order = np.argsort(owner, kind="stable")
            owner, token = owner[order], token[order]
            last = np.arange(len(owner)) + self.need[owner] - 1
            here = np.flatnonzero(last < len(owner))
            last = last[here]
            near = (owner[last] == owner[here]) & (token[last] - token[here] < self.span[owner[here]])
            here, last = here[near], last[near]
            text = np.searchsorted(first, token[here], "right") - 1
            own = token[last] < first[text + 1]
            here, last, text = here[own], last[own], text[own]
            begin, span = first[text], self.span[owner[here]]
            out.append((text, owner[here].astype(np.int64), np.maximum(0, token[last] - begin + 1 - span), token[here] - begin + span))
            a = b
        return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class Block:
    """What a task needs to search one block of the benchmark."""

    idf: np.ndarray
    row_of: np.ndarray  # bucket -> row of the block, 0: none
    reach: np.ndarray  # the largest weight of a row in any passage
    space: np.ndarray
    latent: np.ndarray  # unit-length, of each passage
    found: list[Passage]
    copies: Runs | None
    paraphrases: Runs | None
    answers: Runs | None
    masks: dict[int, dict[int, int]] = field(default_factory=dict)  # of the passages that a task met

    def cosines(self, of: Windows, windows: np.ndarray) -> np.ndarray:
        """Of each of the windows (numbers of their first blocks) and each passage, both projected."""
        size = of.stop[windows + of.left[windows]] - of.begin[windows]
        base = np.cumsum(size) - size
        token = np.repeat(of.begin[windows] - base, size) + np.arange(int(size.sum()))
        folded = np.add.reduceat(self.space[of.feature[token]] * of.weight[token][:, None], base, axis=0)
        return (folded @ self.latent.T) / np.maximum(np.sqrt((folded * folded).sum(axis=1)), 1e-9)[:, None]

    def near(self, of: Windows) -> Iterator[tuple[int, int, float]]:
        """(window, passage, cosine) with a cosine of at least NEAR."""
        own = of.sums(of.weight * self.reach[of.row])
        pick = np.flatnonzero(of.starts & (own >= SHARED * np.sqrt(of.square)) & (own > 0))
        for part in range(0, len(pick), 256):
            windows = pick[part : part + 256]
            cosine = self.cosines(of, windows)
            for w, p in zip(*np.nonzero(cosine >= NEAR)):
                yield int(windows[w]), int(p), float(cosine[w, p])

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(text, item_id, cosine, share, answer_share, word) of the leaks in a chunk, the best for each text and item."""
        hashes, first = _words(data, offsets)
        if not len(hashes) or not self.found:
            return
        at = (hashes >> SHIFT).astype(np.int64)
        n_words = np.diff(first)
        n_blocks = -(-n_words // STRIDE)
        block_text = np.repeat(np.arange(len(n_words)), n_blocks)
        block_no = np.arange(len(block_text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        begin = first[block_text] + block_no * STRIDE
        left = np.minimum(WINDOW // STRIDE, n_blocks[block_text] - block_no)
        of = Windows(IDF[self.idf[at]], self.row_of[at], at * FEATURES // BUCKETS, begin, np.append(begin, len(hashes)), left, (left == WINDOW // STRIDE) | (block_no == 0), np.zeros(0))
        of.square = of.sums(of.weight * of.weight)
        every = self.found
        hits: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for block, p, cosine in self.near(of):
            hits.setdefault((int(block_text[block]), p), []).append((cosine, int(block_no[block]) * STRIDE))
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (text, p), where in hits.items():
            spans[text, p] = [(max(0, s - len(every[p].words)), s + WINDOW + len(every[p].words)) for _, s in where]
        copied, half = self.copies.candidates(of.row, first), self.paraphrases.candidates(of.row, first)
        answered = self.answers.candidates(of.row, first)
        also = np.isin(half[0] * len(every) + half[1], answered[0] * len(every) + answered[1])
        for text, p, lo, hi in zip(*(np.concatenate((a, b[also])).tolist() for a, b in zip(copied, half))):
            spans.setdefault((text, p), []).append((lo, hi))
        best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        for (text, p), where in spans.items():
            found = every[p]
            if p not in self.masks:
                self.masks[p] = _masks(found.words)
            own_words = hashes[first[text] : first[text + 1]]
            for lo, hi in _regions(where):
                share, answer, word = best_share(own_words[lo:hi], found.words, found.answer, self.masks[p])
                if share:
                    cosine = max((c for c, _ in hits.get((text, p), [])), default=None)
                    if cosine is None:
                        cosine = self.cosine(of, np.flatnonzero(block_text == text), p, lo + word)
                    new = (share, answer, cosine, lo + word)
                    if new > best.get((text, found.item_id), (0.0, 0.0, 0.0, 0)):
                        best[text, found.item_id] = new
        for (text, item), (share, answer, cosine_, word) in best.items():
            yield text, item, cosine_, share, answer, word

    def cosine(self, of: Windows, blocks: np.ndarray, p: int, word: int) -> float:
        """The largest cosine of a passage to a window of a text (given as its blocks) that has a word in common with what was found."""
        no = np.arange(len(blocks)) * STRIDE
        windows = blocks[of.starts[blocks] & (no < word + len(self.found[p].words) * 3 // 2) & (no + WINDOW > word)]
        return float(self.cosines(of, windows)[:, p].max(initial=0.0)) if len(windows) else 0.0


def _regions(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that touch joined."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of ``b``."""
    masks = _masks(b)
    return _subsequence([m for w in a.tolist() if (m := masks.get(w))], len(b))


def _masks(b: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _subsequence(places: list[int], n: int) -> int:
    """The same for a sequence given as its words' places among the n words."""
    row = full = (1 << n) - 1
    for m in places:
        u = row & m
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def best_share(own: np.ndarray, passage: np.ndarray, answer: np.ndarray, masks: dict[int, int] | None = None) -> tuple[float, float, int]:
    """Of the spans of one and a half times the passage's length that are a leak, the one with the largest share of the passage's words in
    order: that share, the answer's and the word where the span begins. (0, 0, 0) if none is. ``masks``: the passage's, if they are known."""
    n, length = len(passage), len(passage) * 3 // 2
    if n < LEAST:
        return word_for_word(own, passage, answer)
    masks, words = masks or _masks(passage), own.tolist()
    places = [m for m in map(masks.get, words) if m]  # plain lookups: most candidates end here, and numpy's calls cost more than these few words
    if len(places) < PARAPHRASE * n or reduce(or_, places).bit_count() < PARAPHRASE * n or _subsequence(places, n) < PARAPHRASE * n:
        return 0.0, 0.0, 0
    at = np.array([i for i, w in enumerate(words) if w in masks])
    best, best_answer, word = 0, 0.0, 0
    for lo, (s, hi) in enumerate(zip(at.tolist(), np.searchsorted(at, at + length).tolist())):
        if hi - lo <= best or hi - lo < PARAPHRASE * n or (found := _subsequence(places[lo:hi], n)) <= best or found / n < PARAPHRASE:
            continue
        held = lcs(own[s : s + length], answer) / max(1, len(answer))
        if found / n >= VERBATIM or held >= ANSWER:
            best, best_answer, word = found, held, s
            if best == n:
                break
    return best / n, best_answer, word


def word_for_word(own: np.ndarray, passage: np.ndarray, answer: np.ndarray) -> tuple[float, float, int]:
    """The same for a passage of which no word may be missing."""
    n = len(passage)
    for s in np.flatnonzero(own == passage[0]).tolist():
        if np.array_equal(own[s : s + n], passage):
            return 1.0, lcs(own[s : s + n], answer) / max(1, len(answer)), s
    return 0.0, 0.0, 0


def _table(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words' buckets in order, and the table of their numbers from 1."""
    buckets = np.unique(np.concatenate(words) >> SHIFT).astype(np.int64) if words else np.zeros(0, np.int64)
    row_of = np.zeros(BUCKETS, dtype=np.uint16 if len(buckets) < 65535 else np.uint32)
    row_of[buckets] = 1 + np.arange(len(buckets))
    return buckets, row_of


def block(bench: DataFrame, idf: np.ndarray, space: np.ndarray) -> Block:
    """One block of the benchmark (key, text, answer); its rows, of about QUERIES passages, come to the driver."""
    found = passages(sorted((tuple(r) for r in bench.collect()), key=lambda r: (r[0], r[1], r[2] or "")))
    buckets, row_of = _table([words for p in found for words in (p.words, p.answer)])
    reach = np.zeros(len(buckets) + 1, dtype=np.float32)
    latent = np.zeros((len(found), space.shape[1]), dtype=np.float32)
    if not found:
        return Block(idf, row_of, reach, space, latent, found, None, None, None)
    for at, w in _rows(found, buckets, idf[buckets]):
        np.maximum.at(reach, at, w.astype(np.float32))
    for i, p in enumerate(found):
        at, w = vector(p.words, idf)
        latent[i] = w @ space[at]
    latent /= np.maximum(np.sqrt((latent * latent).sum(axis=1)), 1e-9)[:, None]
    copies, paraphrases, answers = [], [], []
    for p in found:
        n, share = len(p.words), lambda part, words: math.ceil(part * len(words) - 1e-9)
        span, short, least = n * 3 // 2, n < LEAST, share(PARAPHRASE, p.words)
        copies.append((p.words, n if short else share(VERBATIM, p.words), n if short else span, HELD))
        # of half the words many are frequent ones, so more of them are asked for
        paraphrases.append((p.words[:0] if short else p.words, least, span, -(-least // 2)))
        answers.append((p.answer, share(ANSWER, p.answer), span, HELD))
    return Block(idf, row_of, reach, space, latent, found, *(Runs.of(wanted, row_of, idf) for wanted in (copies, paraphrases, answers)))


def asked(bench: DataFrame) -> DataFrame:
    """item_id, key, text, answer: the items that can be searched. Items with one text and answer have one key."""
    answer = F.col("answer").cast("string") if "answer" in bench.columns else F.lit(None).cast("string")
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer")).filter("text is not null").distinct()
    return items.withColumn("key", F.xxhash64("text", "answer"))


def indexes(docs: DataFrame, items: DataFrame) -> Iterator[tuple[Block, bool]]:
    """An index for each block of the benchmark's different texts, and whether it is the last. What one needs can be freed when the next is asked for."""
    texts = items.select("key", "text", "answer").distinct()
    size = F.greatest(F.lit(1), F.ceil(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")) / (LONGEST // 2)))
    n = texts.agg(F.sum(size)).first()[0]
    if not n:
        return
    idf = weights(docs)
    space = fitted_space(docs, texts, idf)
    blocks = -(-int(n) // QUERIES)
    for i in range(blocks):
        yield block(texts.filter(F.pmod("key", F.lit(blocks)) == i) if blocks > 1 else texts, idf, space), i == blocks - 1


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share, answer_share, word: one row for each document and item of which it holds a passage."""
    spark, out, items = docs.sparkSession, None, asked(bench)
    schema = "doc_id long, key long, cosine double, share double, answer_share double, word long"
    for index, _ in indexes(docs, items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            for batch in batches:
                ids = batch.column(0)
                for a, _, data, offsets in textpack.chunks(batch.column(1)):
                    rows = [(ids[a + text].as_py(), *rest) for text, *rest in shared.value.leaks(data, offsets)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

        found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "leaks")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.join(items.select("item_id", "key"), "key").select("doc_id", "item_id", "cosine", "share", "answer_share", "word")


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with their columns, where they lie. With several blocks of passages, what a block leaves is written before the next one."""
    at = docs.columns.index("text")
    schema, source = docs.schema, docs
    for index, last in indexes(source, asked(bench)):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for a, _, data, offsets in textpack.chunks(batch.column(at)):
                    for text, *_ in shared.value.leaks(data, offsets):
                        keep[a + text] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
        if not last:
            docs = written(docs, "clean")
            shared.destroy()
    return docs
