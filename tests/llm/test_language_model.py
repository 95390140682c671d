import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import gru, language_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, score string, row long, word string, n_tokens int"


def docs(spark, data):
    return spark.createDataFrame([(i, t, "x", 1, "w", 2) for i, t in data], SCHEMA)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute(data):
    words = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in data]
    c = Counter(w for (i, _), own in zip(data, words) if not held(i) for w in own)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 5)) for (i, _), own in zip(data, words)), key=repr)


def check(spark, data):
    rows = language_model.score_documents(docs(spark, data)).collect()
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in rows)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows), key=repr) == brute(data)
    return rows


def tongue(i, r, n):
    kinds = ("ba", "kö", "ñu", "lé")
    return " ".join(f"{kinds[i % 4]}{min(int(r.paretovariate(0.7)), 300)}{r.choice(['', '', '.'])}" for _ in range(n))


def corpus(n, length, seed=1):
    r = random.Random(seed)
    return [(i, tongue(i, r, r.randint(1, length))) for i in range(n)]


ODD = [(None, "Ünï word"), (None, None), (3, None), (4, ""), (5, " \t\n"), (6, "x" * 9000 + "\x0by\x85z Z " + "é" * 70), (7, "never-seen " * 300), (7, "twice"), (7, "twice"), (8, "ABC abc aBc")]


def test_counts_and_base_score(spark):
    check(spark, ODD + corpus(120, 60))
    check(spark, [])
    check(spark, [(next(i for i in range(99) if held(i)), "only held out")])
    check(spark, [(1, None)])


def test_words_beyond_the_broadcast_table(spark, monkeypatch):
    data = ODD + corpus(80, 40)
    whole = check(spark, data)
    monkeypatch.setattr(language_model, "TABLE", 20)
    assert [(r.doc_id, r.n_known, r.n_tokens) for r in sorted(check(spark, data), key=repr)] == [(r.doc_id, r.n_known, r.n_tokens) for r in sorted(whole, key=repr)]


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = [r for r in language_model.score_documents(docs(spark, corpus(900, 120)), shares=2).collect() if r.held_out]
    assert len(rows) > 100
    assert sum(r.score for r in rows) / sum(r.n_tokens for r in rows) > sum(r.base_score for r in rows) / sum(r.n_tokens for r in rows) + 0.2
    again = language_model.score_documents(docs(spark, corpus(900, 120)), shares=2).collect()
    assert {r.doc_id: r.score for r in again if r.held_out} == pytest.approx({r.doc_id: r.score for r in rows})


def some_model(seed=0):
    r = np.random.default_rng(seed)
    counts = r.integers(0, 50, gru.WORDS).astype(float)
    counts[gru.WORDS - 100 :] = -1
    flat = gru.initial(counts, r.integers(0, 9, gru.OTHERS).astype(float))
    return gru.views(flat + r.normal(0, 0.05, gru.SIZE).astype(np.float32)), r


def plain(p, text):
    """The score of one text, word by word."""
    h, x, total = np.zeros(gru.HIDDEN), gru.BEGIN, 0.0
    H, sigmoid, logs = gru.HIDDEN, lambda v: 1 / (1 + np.exp(-v)), lambda v: v - v.max() - np.log(np.exp(v - v.max()).sum())
    p = {k: v.astype(np.float64) for k, v in p.items()}
    for y in text:
        g, u = p["gates"][x] + p["bias"], h @ p["recur"]
        z, r = sigmoid(g[:H] + u[:H]), sigmoid(g[H : 2 * H] + u[H : 2 * H])
        h = (1 - z) * np.tanh(g[2 * H :] + r * u[2 * H :]) + z * h
        classes = logs(h @ p["to_class"] + p["class_bias"])
        if y < gru.WORDS:
            own = slice(y // gru.WIDTH * gru.WIDTH, (y // gru.WIDTH + 1) * gru.WIDTH)
            total += classes[y // gru.WIDTH] + logs(p["to_word"][own] @ h + p["word_bias"][own])[y % gru.WIDTH]
        else:
            total += classes[gru.CLASSES + y - gru.WORDS]
        x = y
    return total / np.log(10)


def test_lanes_and_windows_give_the_score_of_whole_texts():
    p, r = some_model()
    texts = [r.integers(0, gru.WORDS + gru.OTHERS, n) for n in [1, 1, 2, 31, 32, 33, 700, 5, *r.integers(1, 90, 400)]]
    got = gru.log10_probabilities(p, np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    assert got[:40] == pytest.approx([plain(p, t) for t in texts[:40]], rel=1e-4)


def test_probabilities_add_up_to_one():
    p, r = some_model(1)
    y = np.arange(gru.WORDS + gru.OTHERS)
    s = np.repeat(r.normal(0, 0.5, (1, gru.HIDDEN)).astype(np.float32), len(y), axis=0)
    assert np.exp(gru.outputs(p, s, y)[0]).sum() == pytest.approx(1, abs=1e-4)


def test_gradients():
    p, r = some_model(2)
    y, x = r.integers(0, gru.WORDS + gru.OTHERS, (5, 3)), r.integers(0, gru.BEGIN + 1, (5, 3))
    begins, h = r.random((5, 3)) < 0.2, r.normal(0, 0.3, (3, gru.HIDDEN)).astype(np.float32)

    def loss():
        return -gru.outputs(p, gru.run(p, x, begins, h)[0].reshape(-1, gru.HIDDEN), y.reshape(-1))[0].mean()

    trace, grads = [], {}
    states, _ = gru.run(p, x, begins, h, trace)
    d = gru.outputs(p, states.reshape(-1, gru.HIDDEN), y.reshape(-1), grads)[1].reshape(states.shape)
    by_gates, by_recur = gru.back(p, x, d, trace)
    rows = np.zeros_like(p["gates"])
    np.add.at(rows, x.reshape(-1), by_gates.reshape(-1, 3 * gru.HIDDEN))
    own, by_word, by_bias = grads["words"][0]
    checks = [("gates", (x[2, 1], k), rows[x[2, 1], k]) for k in (0, 30, 60)] + [("recur", (k, 3 * k), by_recur[k, 3 * k]) for k in range(0, 24, 5)]
    checks += [("to_class", (4, 5), grads["to_class"][4, 5]), ("class_bias", (7,), grads["class_bias"][7]), ("to_word", (own.start + 3, 2), by_word[3, 2]), ("word_bias", (own.start + 1,), by_bias[1])]
    for name, at, got in checks:
        was = p[name][at]
        p[name][at] = was + 0.02
        up = loss()
        p[name][at] = was - 0.02
        down = loss()
        p[name][at] = was
        assert got == pytest.approx((up - down) / 0.04, abs=2e-4, rel=0.03), (name, at)


def test_every_training_document_is_learnt_from(spark):
    """Each training document falls into just one round's share."""
    df = spark.range(3000).withColumnRenamed("id", "doc_id").filter(~language_model.held_out(F.col("doc_id")))
    share = F.pmod(F.xxhash64(F.lit(language_model.SEED), "doc_id"), F.lit(language_model.SHARES))
    assert df.filter(share < language_model.ROUNDS).count() == df.count()
