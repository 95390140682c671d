"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other documents are unlabelled, those labelled clean too. With the class prior p (the
share of toxic rows among the labels that may be learnt from) the risk is

    p * E_P[loss(f)] + max(0, E_U[loss(-f)] - p * E_P[loss(-f)])

with logistic loss; where the second part would fall below 0, its gradient is reversed, which keeps the classifier from explaining away
the positives among the unlabelled. Several linear classifiers are trained in numpy with different seeds; the score is the sigmoid of
their mean margin: the bias and the sum of the weights of a text's different features over the square root of their number.

Features are the different tokens of a text and the first four and six bytes of each, hashed, so that inflected and compounded insults
are learnt by their stem; those in under ``LEAST`` documents or ``RARE`` of the sample, or over ``MOST`` of it,
are left out.
Positives and unlabelled rows are samples bounded by ``POSITIVES`` and ``UNLABELLED``; every whole text is scored, where it lies, without a shuffle.

Nulls: a null or empty text gets the bias's score. Without any positive the score is 0. Repeated rows are scored each. An empty table gives
an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import labelled, textpack

#: Most confirmed toxic and most unlabelled documents that are learnt from.
POSITIVES, UNLABELLED = 3000, 9000
LEAST, RARE, MOST = 8, 0.001, 0.15
STEMS = (4, 6)
MODELS, EPOCHS, STEPS, LEAST_BATCH, RATE, DECAY = 3, 20, 16, 32, 50.0, 1e-5
#: Share of the prior that the unlabelled rows scored 0.5 or more make up.
SHARE = 0.97
BIAS_RATE = 1.0
THRESHOLD = 0.5
SEED = 5
SIZE = 1 << labelled.BITS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, first): every token of the texts of a chunk and its prefixes."""
    hashes, starts, ends, first = textpack.words(data, offsets, textpack.TYPED)
    all_ = np.stack([hashes, *(textpack.prefixes(data, starts, ends, n) for n in STEMS)], axis=1)
    keep = all_ != 0
    counts = np.concatenate(([0], np.cumsum(keep.sum(axis=1))))
    return (all_[keep] >> np.uint64(64 - labelled.BITS)).astype(np.int64), counts[first]


class Model:
    """used: False for features that are left out."""

    def __init__(self, weights: np.ndarray, bias: float, used: np.ndarray):
        self.weights, self.bias, self.used = weights, bias, used

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found, first = features(data, offsets)
        keep = self.used[found]
        key = np.unique(textpack.per_text(first)[keep] * SIZE + found[keep])
        margin = np.bincount(key // SIZE, weights=self.weights[key % SIZE], minlength=len(first) - 1)
        return labelled.sigmoid(self.bias + margin / np.sqrt(1 + np.bincount(key // SIZE, minlength=len(first) - 1)))


def _packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)


def nnpu_gradient(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Derivatives by the margins of a batch's positives and unlabelled rows, and the estimated risk. loss(f) = log(1 + exp(-f))."""
    up, uu = labelled.sigmoid(pos), labelled.sigmoid(unl)
    negative = np.mean(np.logaddexp(0, unl)) - prior * np.mean(np.logaddexp(0, pos))
    risk = prior * np.mean(np.logaddexp(0, -pos)) + max(0.0, negative)
    if negative < 0:
        return prior * up / len(pos), -uu / len(unl), risk
    return prior * (up - 1) / len(pos) - prior * up / len(pos), uu / len(unl), risk


def fitted(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    if not positive or not unlabelled:
        return Model(np.zeros(SIZE), -35.0, np.zeros(SIZE, dtype=bool))
    n = len(positive) + len(unlabelled)
    # common is what many of the unlabelled hold: the positives are drawn more often than they occur
    df = np.bincount(np.concatenate([*positive, *unlabelled]), minlength=SIZE)
    used = (df >= min(max(LEAST, RARE * n), max(1, len(positive) // 4))) & (np.bincount(np.concatenate(unlabelled), minlength=SIZE) <= MOST * len(unlabelled))
    positive, unlabelled = [r[used[r]] for r in positive], [r[used[r]] for r in unlabelled]
    total, base = np.zeros(SIZE), 0.0
    for model in range(MODELS):
        rng = np.random.default_rng(SEED + model)
        w, b = np.zeros(SIZE + 1), 0.0
        m = np.zeros(SIZE + 1)
        w[SIZE] = np.log(prior / (1 - prior))
        for _ in range(EPOCHS):
            order_p, order_u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
            n = max(1, min(STEPS, len(unlabelled) // LEAST_BATCH))
            for part_p, part_u in zip(np.array_split(order_p, n), np.array_split(order_u, n)):
                if not len(part_p):
                    part_p = rng.integers(0, len(positive), 8)
                (ip, fp), (iu, fu) = _packed([positive[i] for i in part_p]), _packed([unlabelled[i] for i in part_u])
                sp, su = 1 / np.sqrt(1 + np.diff(fp)), 1 / np.sqrt(1 + np.diff(fu))
                gp, gu, _ = nnpu_gradient(w[SIZE] + sp * labelled.sums(w[ip], fp), w[SIZE] + su * labelled.sums(w[iu], fu), prior)
                g = np.bincount(np.concatenate((ip, iu)), weights=np.concatenate((np.repeat(gp * sp, np.diff(fp)), np.repeat(gu * su, np.diff(fu)))), minlength=SIZE + 1)
                g[SIZE] = gp.sum() + gu.sum()
                g[:SIZE] += DECAY * w[:SIZE]
                m += 0.1 * (g - m)
                w -= RATE * m
                w[SIZE] += (RATE - BIAS_RATE) * m[SIZE]
        total += w[:SIZE] / MODELS
        base += w[SIZE] / MODELS
    # the class prior corrects the bias as well: that share of the unlabelled rows is to come out toxic
    margins = base + np.array([total[r].sum() / np.sqrt(1 + len(r)) for r in unlabelled])
    base -= np.quantile(margins, 1 - SHARE * prior)
    return Model(np.where(used, total, 0.0).astype(np.float32), float(base), used)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    known = labelled.training_labels(labels, "toxic")
    n, toxic = known.agg(F.count("*"), F.sum("y")).first()
    if not toxic:
        return fitted([], [], 0.5)
    prior = min(0.9, max(1e-4, toxic / n))
    positives = labelled.drawn(known.filter("y = 1"), POSITIVES, SEED)
    others = labelled.drawn(docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~labelled.held_out(F.col("doc_id"))), UNLABELLED, SEED + 1)
    # 1: a positive, 2: drawn as unlabelled, 3: both, as the unlabelled are to be like all documents
    ids = others.select("doc_id").distinct().select("doc_id", F.lit(2).alias("y")).unionByName(positives).groupBy("doc_id").agg(F.sum("y").cast("int").alias("y"))
    rows = labelled.sample_features(docs, ids, features)
    return fitted([r[2] for r in rows if r[1] & 1], [r[2] for r in rows if r[1] & 2], prior)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return labelled.scored(docs, lambda data, offsets: shared.value.score(data, offsets), THRESHOLD)
