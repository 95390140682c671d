"""Bounded labelled samples, folds and document scoring shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import textpack
from ledgerlark.llm.shared import written

#: Hash buckets of a model: 2**BITS weights.
BITS = 18
FOLDS = 5
#: Most features, each with its count, of all sampled documents together: 8 bytes each on the driver.
FEATURES = 1 << 24
#: Grain of the hash by which rows are drawn for a sample.
GRAIN = 1 << 30


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learnt from. A null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def drawn(ids: DataFrame, rows: int, seed: int) -> DataFrame:
    """About ``rows`` of the rows (never over a quarter and 200 more), by a hash of doc_id: the same ones each time."""
    n = ids.count()
    return ids if n <= rows else ids.filter(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(GRAIN)) < int(GRAIN * rows / n))


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """doc_id, y: the learnable labels. Rows without an id or a label don't count; of contradicting rows the mean counts, from 0.5 up as 1."""
    known = labels.select("doc_id", F.col(name).cast("double").alias("y")).filter("doc_id is not null and y is not null").filter(~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


Extract = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def sample_features(docs: DataFrame, ids: DataFrame, extract: Extract) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(doc_id, y, feature, count) of the sampled documents, on the driver, by doc_id. ``ids`` (doc_id, y) is a bounded sample, so that its
    broadcast is bounded. Of rows with one doc_id, one is learnt from, chosen before anything comes to the driver; and if the sample has more than ``FEATURES`` features, only as many of its documents,
    by a hash of doc_id, as have no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, data, offsets in textpack.chunks(batch.column(2)):
                found, first = extract(data, offsets)
                pairs = [np.unique(found[first[i] : first[i + 1]], return_counts=True) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array(ys[a:b], pa.int32()), pa.array([x.astype("<i4").tobytes() for x, _ in pairs], pa.binary()), pa.array([x.astype("<i4").tobytes() for _, x in pairs], pa.binary())],
                    names=["doc_id", "y", "feature", "count"],
                )

    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, feature binary, count binary")
    one = written(found.groupBy("doc_id").agg(F.max(F.struct("feature", "count", "y")).alias("x")).select("doc_id", "x.*", F.xxhash64("doc_id").alias("drawn")), "sample")
    size = (F.octet_length("feature") / 4).cast("long")
    if (one.agg(F.sum(size)).first()[0] or 0) > FEATURES:
        sizes = sorted((r["drawn"], r["n"]) for r in one.select("drawn", size.alias("n")).collect())
        kept = int(np.searchsorted(np.cumsum([n for _, n in sizes]), FEATURES, "right"))
        one = one.filter(F.col("drawn") < sizes[kept][0])
    rows = sorted(one.collect(), key=lambda r: r["doc_id"])
    return [(r["doc_id"], r["y"], np.frombuffer(r["feature"], "<i4"), np.frombuffer(r["count"], "<i4")) for r in rows]


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [score(data, offsets) for _, _, data, offsets in textpack.chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got) if got else [], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each text's values."""
    run = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return run[first[1:]] - run[first[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
