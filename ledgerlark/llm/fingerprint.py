"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (a piece between newlines) is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, so it doesn't depend on their order, and a paragraph is inserted or deleted by adding or
subtracting its vector. The vector has two parts:

* 64 lanes modulo 2**32, the paragraph's SHAKE-128 output: for equality;
* 256 lanes modulo 2**32, the paragraph's runs of three words, each counted up or down in one lane: the squared
  length of a difference of two such sums estimates how many runs differ (standard error about 9 %), for likeness.

Nulls: a null text is an empty one; it has no paragraph, and its fingerprint is all zeros. Rows with a null doc_id come after the others,
in the order of their texts. Rows that share a doc_id follow each other in the order of their texts. One document alone is
its own next. An empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import textpack
from ledgerlark.llm.shared import parallelism

EXACT, LIKE, RUN = 64, 256, 3
NEWLINE = 10


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each text's sum: uint32 of (texts, EXACT) and of (texts, LIKE)."""
    exact, like = np.zeros((len(texts), EXACT), dtype=np.uint32), np.zeros((len(texts), LIKE), dtype=np.uint32)
    packed = [t.encode() for t in texts]
    for a, b, data, offsets in textpack.chunks(pa.array(packed, type=pa.binary()).cast(pa.string())):
        digests, counts = [], np.zeros(b - a, dtype=np.int64)
        for i, t in enumerate(packed[a:b]):
            own = t.split(b"\n") if t else []
            counts[i] = len(own)
            digests += [hashlib.shake_128(p).digest(4 * EXACT) for p in own]
        if digests:
            full = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[full]
            exact[a + full] = np.add.reduceat(np.frombuffer(b"".join(digests), dtype="<u4").reshape(-1, EXACT), starts, axis=0)
        bounds = np.union1d(offsets, np.flatnonzero(data == NEWLINE) + 1)
        hashes, _, _, first = textpack.words(data, bounds, textpack.SPACED, lower=False)
        runs, first = textpack.shingles(hashes, first, RUN)
        if len(runs):
            at = first[np.searchsorted(bounds, offsets)]
            text = np.repeat(np.arange(b - a), np.diff(at))
            lane = (runs & np.uint64(LIKE - 1)).astype(np.int64)
            sign = 1.0 - 2.0 * ((runs >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
            sums = np.bincount(text * LIKE + lane, weights=sign, minlength=(b - a) * LIKE)
            like[a:b] = sums.astype(np.int64).astype(np.uint32).reshape(-1, LIKE)
    return exact, like


def encoded(exact: np.ndarray, like: np.ndarray) -> str:
    return base64.b64encode(exact.astype("<u4").tobytes() + like.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 4 * EXACT], dtype="<u4"), np.frombuffer(raw[4 * EXACT :], dtype="<u4")


def fingerprint(text: str | None) -> str:
    exact, like = vectors([text or ""])
    return encoded(exact[0], like[0])


def inserted(fp: str, paragraphs: list[str]) -> str:
    """The fingerprint after the paragraphs were added, wherever they stand."""
    exact, like = decoded(fp)
    return encoded(exact + sum(vectors([p])[0][0] if p else _empty() for p in paragraphs), like + sum(vectors([p])[1][0] for p in paragraphs))


def deleted(fp: str, paragraphs: list[str]) -> str:
    exact, like = decoded(fp)
    return encoded(exact - sum(vectors([p])[0][0] if p else _empty() for p in paragraphs), like - sum(vectors([p])[1][0] for p in paragraphs))


def _empty() -> np.ndarray:
    return np.frombuffer(hashlib.shake_128(b"").digest(4 * EXACT), dtype="<u4")


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, 0 to 1: 1 for equal fingerprints, about the share of runs of words in common otherwise."""
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    both = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    equal = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        near = np.where(both > 0, 2 * (x * y).sum(axis=1) / both, 0.0)
    return np.where(equal, 1.0, np.clip(near, 0.0, 1.0))


def _bucket(bounds: list[int], low: int = 0) -> Column:
    """The number of bounds that are not above doc_id, by halving."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(F.col("doc_id") < bounds[mid], _bucket(bounds[:mid], low)).otherwise(_bucket(bounds[mid + 1 :], low + mid + 1))


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, guest, doc_id, text): one partition for each range of doc_id, sorted; its last row, the guest, is the first document of the
    next range. Each text moves once; the driver sees one number per range."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = docs.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else None
    bucket = _bucket(sorted(set(cuts or ())))
    ranged = docs.withColumn("bucket", bucket)
    heads = sorted((r["bucket"], r["head"]) for r in ranged.groupBy("bucket").agg(F.min("doc_id").alias("head")).collect())
    if not heads:
        return ranged.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    wanted = F.col("doc_id").isin([h for _, h in heads if h is not None])
    for b, h in heads:
        if h is None:
            wanted = F.coalesce(wanted, F.lit(False)) | (F.col("bucket") == b)
    moved = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    guests = (
        ranged.filter(wanted).groupBy("bucket").agg(F.min(F.struct(F.col("doc_id"), F.col("text"))).alias("head"))
        .select(F.element_at(moved, F.col("bucket")).alias("bucket"), F.lit(True).alias("guest"), "head.doc_id", "head.text")
    )
    both = ranged.select("bucket", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests)
    return both.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_last(), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        step = max(1, min(batch.num_rows, (4 << 20) * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            bucket, guest, ids = (part.column(i).to_pylist() for i in range(3))
            texts = part.column(3).fill_null("").to_pylist()
            exact, like = vectors(texts)
            if last is not None:
                bucket, guest, ids, texts = [last[0], *bucket], [False, *guest], [last[1], *ids], [last[2], *texts]
                exact, like = np.vstack([last[3], exact]), np.vstack([last[4], like])
            own = [i for i in range(len(ids) - 1) if not guest[i] and bucket[i] == bucket[i + 1]]
            edited = [texts[i][: len(texts[i]) - (k := len(texts[i]) // 2)] + texts[i + 1][:k] for i in own]
            new, pick = vectors(edited), np.array(own, dtype=np.int64)
            near = likeness((exact[pick], like[pick]), new)
            following = likeness((exact[pick], like[pick]), (exact[pick + 1], like[pick + 1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([encoded(exact[i], like[i]) for i in own], pa.string()),
                    pa.array([encoded(*x) for x in zip(*new)], pa.string()),
                    pa.array(near, pa.float64()),
                    pa.array(following, pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            last = None if guest[-1] else (bucket[-1], ids[-1], texts[-1], exact[-1:], like[-1:])


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text (the last half replaced by the start of the next document), and the
    likeness of its fingerprint to the edited text's and to the next document's."""
    return in_order(docs, parallelism(docs.sparkSession)).mapInArrow(_compare, SCHEMA)
