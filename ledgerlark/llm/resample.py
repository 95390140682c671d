"""Importance resampling to a target distribution: the documents whose hashed word runs are likelier in the target than in the corpus, drawn by Gumbel noise.

A feature is a run of 1 to ``longest`` words; its bucket is its CRC-32 modulo ``BUCKETS``. One pass counts the buckets of the corpus and of the target, a second scores every whole text
with the array of gains: the mean gain of its features, rounded down, plus noise that only doc_id decides. Both passes are numpy over packed bytes, without a loop over words.

The draw is exact without a global sort: scores are whole numbers, at most some hundred thousand of them (gains are logarithms of counts, noise one of 2^32 values), so their histogram is
bounded. Summed from its upper end it gives the cutoff score and the first rank of each score; only the rows from the cutoff up move, each to its place in ranges of (score, doc_id), and a row's rank is its
range's and score's offset and its row number there. A score that very many rows share, or rows repeated very often, spread over ranges.

Nulls: a null text counts as empty; without features the weight is 0. A null doc_id is hashed as ``null`` and stands after all others of its score. Rows that share a doc_id share the noise and take
ranks next to each other if their scores are equal. Fewer than ``100 / percent`` long enough documents, or none, draw nothing. An empty target or corpus has no features: every gain comes
from the smoothing. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.llm import textpack
from ledgerlark.llm.shared import parallelism, written

BUCKETS = 10_000
LONGEST, LEAST, PERCENT, SEED = 1, 20, 10, 2024
#: Words with more bytes are hashed one by one.
LONG = 48

#: 1 for what a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` holds; capitals count, as they are lower-cased.
WORDS = np.zeros(256, dtype=np.uint8)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORDS[_a:_b] = 1

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def advanced(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 registers ``crc`` after the bytes of the words: byte by byte for all words at once, the longest first."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    order = order[int(np.searchsorted(-sizes[order], -LONG)) :]
    size, at, now = -sizes[order], starts[order], crc[order]
    for i in range(int(-size[0]) if len(size) else 0):
        n = int(np.searchsorted(size, -i))
        now[:n] = _CRC[(now[:n] ^ data[at[:n] + i]) & 255] ^ (now[:n] >> 8)
    out = crc.copy()
    out[order] = now
    for i in np.flatnonzero(sizes > LONG):
        out[i] = ~np.uint32(zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(~crc[i])))
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every run of 1 to ``longest`` words of a chunk's texts, and each text's number of words."""
    low = textpack.LOWER[data]
    _, starts, ends, first = textpack.words(data, offsets, WORDS)
    text, nth = textpack.per_text(first), np.arange(len(starts))
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    texts, found = [], []
    for i in range(longest):
        if i:
            keep = nth + i < len(starts)
            keep[keep] = text[nth[keep] + i] == text[nth[keep]]
            nth, crc = nth[keep], crc[keep]
            crc = _CRC[(crc ^ np.uint32(32)) & 255] ^ (crc >> 8)
        crc = advanced(crc, low, starts[nth + i], ends[nth + i])
        texts.append(text[nth])
        found.append((~crc % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(found), np.diff(first)


def counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the column ``text`` each bucket holds: an array of ``buckets`` numbers. Each task sends one row for each bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in textpack.chunks(batch.column(0)):
                total += np.bincount(features(data, offsets, longest, buckets)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much likelier each bucket is in the target, one added to each bucket, rounded down."""
    s, t, size = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight: one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.astype(np.float64)
        for batch in batches:
            for a, b, data, offsets in textpack.chunks(batch.column(1)):
                text, found, n_words = features(data, offsets, longest, len(own))
                n = np.bincount(text, minlength=b - a)
                total = np.bincount(text, own[found], minlength=b - a).astype(np.int64)  # whole numbers below 2^53: exact
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in (n_words, n, np.where(n > 0, total // np.maximum(n, 1), 0)))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """A thousand times the standard Gumbel variate of doc_id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``scored`` (doc_id, score, able, row) with ``rank``: 1, 2, 3... of the ``drawn`` highest scores among the able rows, ties by doc_id, null for the others. ``scored`` is read several times, so it should be a written table."""
    spark = scored.sparkSession
    histogram = sorted(((r["score"], r["n"]) for r in scored.filter("able").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    above = np.concatenate(([0], np.cumsum([n for _, n in histogram]))).astype(np.int64)
    reached = int(np.searchsorted(above, drawn))  # so many scores have drawn rows
    if not drawn or not reached:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cutoff = histogram[reached - 1][0]
    kept = F.col("able") & (F.col("score") >= cutoff)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranges = written(scored.filter(kept).repartitionByRange(parallelism(spark), *order).withColumn("part", F.spark_partition_id()), "ranges")
    # One row for each score of each range: no more than scores and ranges together, as a range holds neighbouring scores.
    parts = sorted(((-r["score"], r["part"], r["n"]) for r in ranges.groupBy("score", "part").agg(F.count("*").alias("n")).collect()))
    before = np.concatenate(([0], np.cumsum([n for *_, n in parts])))
    offsets = spark.createDataFrame([(-s, p, int(b)) for (s, p, _), b in zip(parts, before)], "score long, part int, before long")
    nth = F.row_number().over(W.partitionBy("score", "part").orderBy(F.col("doc_id").asc_nulls_last(), "row"))
    placed = ranges.join(F.broadcast(offsets), ["score", "part"]).withColumn("rank", (F.col("before") + nth).cast("long"))
    placed = placed.select(*scored.columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return placed.unionByName(scored.filter(~kept).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``: ``percent`` % of the documents with at least ``least`` words are drawn towards the texts of ``target``."""
    gain = gains(counts(docs, longest, buckets), counts(target, longest, buckets))
    rows = weighed(docs, gain, longest).withColumns({"score": F.col("weight") + noise(seed), "able": F.col("n_words") >= least, "row": F.monotonically_increasing_id()})
    scored = written(rows.select("doc_id", "n_features", "weight", "score", "able", "row"), "scores")
    drawn = percent * scored.filter("able").count() // 100
    return ranked(scored, drawn).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **parameters: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id was drawn, with their columns. Of rows that share a doc_id all stay if one was drawn; a null doc_id isn't kept."""
    chosen = resampled(docs, target, **parameters).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, docs["doc_id"] == F.col("_drawn"), "left_semi")
