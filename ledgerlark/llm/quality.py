"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader (FTRL-proximal).

Tokens are runs of letters and digits, or of punctuation, lower-cased in ASCII. Features are hashed tokens, pairs of neighbours, and one mark for
a pair of equal neighbours. A feature weighs count / sqrt(all features of the text); a score is the sparse dot product with the learnt
weights.

Training takes at most about ``SAMPLE`` labelled documents outside the held-out fold, on the driver; scoring takes every whole text, where it
lies, without a shuffle.

Nulls: a null or empty text has no feature and gets the score of the bias alone. Without any label (or with one kind only) the score is that
kind's share. Repeated rows are scored each. An empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import labelled, textpack

#: Most labelled documents that are learnt from.
SAMPLE = 4000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.5
THRESHOLD = 0.3
SEED = 8
U64 = np.uint64


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, first) of the texts of a chunk."""
    hashes, _, _, first = textpack.words(data, offsets, textpack.TYPED)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    shift = U64(64 - labelled.BITS)
    text = textpack.per_text(first)
    pair = text[1:] == text[:-1]
    out = np.zeros((n, 3), dtype=np.int64)
    out[:, 0] = hashes >> shift
    out[:-1, 1] = textpack.mix(hashes[:-1] * U64(0xD6E8FEB86659FD93) + hashes[1:]) >> shift
    keep = np.ones((n, 3), dtype=bool)
    keep[-1, 1] = False
    keep[:-1, 1] = pair
    keep[:, 2] = False
    keep[1:, 2] = pair & (hashes[1:] == hashes[:-1])
    counts = np.concatenate(([0], np.cumsum(keep.sum(axis=1))))
    return out[keep], counts[first]


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found, first = features(data, offsets)
        size = np.maximum(np.diff(first), 1)
        return labelled.sigmoid(self.bias + labelled.sums(self.weights[found], first) / np.sqrt(size))


def fitted(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Model:
    """FTRL-proximal over the rows, in a seeded order."""
    z, n, size = np.zeros((1 << labelled.BITS) + 1), np.zeros((1 << labelled.BITS) + 1), 1 << labelled.BITS
    ys = np.array([y for _, y, *_ in rows], dtype=np.float64)
    if not len(rows) or ys.min() == ys.max():
        share = float(ys.mean()) if len(rows) else 0.5
        return Model(np.zeros(size), float(np.log((share + 1e-3) / (1 - share + 1e-3))))

    def weight(at: np.ndarray) -> np.ndarray:
        free = at == size  # the bias isn't regularised
        cut = np.where(free, 0.0, L1)
        return np.where(np.abs(z[at]) <= cut, 0.0, -(z[at] - np.sign(z[at]) * cut) / ((BETA + np.sqrt(n[at])) / ALPHA + np.where(free, 0.0, L2)))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(SEED + epoch).permutation(len(rows)):
            _, y, at, count = rows[i]
            at, x = np.append(at, size), np.append(count / np.sqrt(max(count.sum(), 1.0)), 1.0)
            w = weight(at)
            g = (labelled.sigmoid(np.array([w @ x]))[0] - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return Model(weight(np.arange(size)).astype(np.float32), float(weight(np.array([size]))[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    ids = labelled.drawn(labelled.training_labels(labels, "quality"), sample, SEED)
    return fitted(labelled.sample_features(docs, ids, features))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, train_on: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted. The model is learnt from ``train_on`` (by default from ``docs``)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs if train_on is None else train_on, labels, sample))
    return labelled.scored(docs, lambda data, offsets: shared.value.score(data, offsets), THRESHOLD)


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns: one pass over the texts, no join."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            got = [shared.value.score(data, offsets) for _, _, data, offsets in textpack.chunks(batch.column(at))]
            if got:
                yield batch.filter(pa.array(np.concatenate(got) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
