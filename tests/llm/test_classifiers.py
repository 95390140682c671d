import math
import random
import zlib
from collections import defaultdict

import numpy as np

from ledgerlark.llm import labelled, quality, textpack, toxicity


def make(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.25
        if not good:
            own = [w + "***" for w in own]
        if toxic:
            own += [rng.choice(("grunch", "blargen", "zorbling"))] * rng.randint(1, 3)
        docs.append((i, " ".join(own), "en", "src", 99, 0.5))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, y int, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def accuracy(out, truth):
    own = [r for r in out if r.held_out]
    assert len(own) > 50 and all(r.held_out == fold(r.doc_id) for r in out)
    return np.mean([r.predicted == truth[r.doc_id] for r in own])


def test_held_out_accuracy(spark):
    docs, labels = make(1200)
    d, y = frames(spark, docs, labels)
    good = quality.score_documents(d, y).collect()
    assert len(good) == 1200 and accuracy(good, {i: q for i, q, _ in labels}) > 0.97
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in good)
    toxic = toxicity.score_documents(d, y).collect()
    assert len(toxic) == 1200 and accuracy(toxic, {i: t for i, _, t in labels}) > 0.93
    assert quality.score_documents(d, y).collect() == good and toxicity.score_documents(d, y).collect() == toxic


def test_held_out_labels_are_never_read(spark):
    docs, labels = make(400)
    wrong = [(i, 1 - q, 1 - t) if fold(i) else (i, q, t) for i, q, t in labels]
    for module in (quality, toxicity):
        a, b = (module.score_documents(*frames(spark, docs, x)).collect() for x in (labels, wrong))
        assert a == b


def test_edges(spark):
    docs, labels = make(200)
    odd = [(None, None, None, None, None, None), (900, "", "en", "s", 1, 1.0), (901, None, "en", "s", 1, 1.0), (902, "x " * 100_000, "en", "s", 1, 1.0), (3, docs[3][1], "en", "s", 1, 1.0)]
    d, y = frames(spark, docs + odd, [*labels, (None, 1, 1), (5, None, None), (6, 1, 1), (6, 0, 0)])
    for module in (quality, toxicity):
        out = module.score_documents(d, y).collect()
        assert len(out) == 205 and {r.score for r in out if r.doc_id in (900, 901)} == {r.score for r in out if r.doc_id is None}
        assert module.score_documents(d.limit(0), y).count() == 0
        none = module.score_documents(d, y.limit(0)).collect()
        assert len(none) == 205 and len({r.score for r in none}) == 1
    kept = quality.accepted(d, y)
    assert kept.columns == d.columns and 0 < kept.count() < 205


def test_scores_are_sparse_dot_products():
    docs, labels = make(300)
    rows = []
    for i, text, *_ in docs:
        a = np.frombuffer(text.encode(), np.uint8)
        found, _ = quality.features(a, np.array([0, len(a)]))
        rows.append((i, labels[i][1], *np.unique(found, return_counts=True)))
    model = quality.fitted(rows)
    dense = np.zeros(1 << labelled.BITS)
    np.add.at(dense, rows[7][2], rows[7][3] / np.sqrt(rows[7][3].sum()))
    a = np.frombuffer(docs[7][1].encode(), np.uint8)
    assert np.isclose(model.score(a, np.array([0, len(a)]))[0], labelled.sigmoid(np.array([model.bias + dense @ model.weights]))[0], atol=1e-6)


def test_non_negative_risk():
    pos, unl = np.full(4, -3.0), np.full(4, -8.0)
    gp, gu, risk = toxicity.nnpu_gradient(pos, unl, 0.3)
    negative = np.logaddexp(0, -8.0) - 0.3 * np.logaddexp(0, -3.0)
    assert negative < 0 and np.isclose(risk, 0.3 * np.logaddexp(0, 3.0)) and (gu < 0).all() and (gp > 0).all()
    for k in (0, 1):
        pos, unl = np.array([0.5, 1.0]), np.array([0.2, 3.0])
        gp, gu, risk = toxicity.nnpu_gradient(pos, unl, 0.3)
        step = 1e-6
        moved = (pos + step * (np.arange(2) == k), unl)
        assert np.isclose((toxicity.nnpu_gradient(*moved, 0.3)[2] - risk) / step, gp[k], atol=1e-4)


def test_word_hashes_match_a_plain_tokenizer():
    import re

    import pyarrow as pa

    texts = ["Ab  cd-ä!", "", "cd ab", None, "!!\tÄ ab"]
    seen = {}
    for a, b, data, offsets in textpack.chunks(pa.array(texts), limit=6):
        hashes, starts, ends, first = textpack.words(data, offsets, textpack.SPACED)
        for i in range(b - a):
            own = re.findall(r"[^\x20\x09-\x0D]+", (texts[a + i] or "").replace("A", "a"))
            assert [bytes(data[s:e]).decode().replace("A", "a") for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == own
            for w, h in zip(own, hashes[first[i] : first[i + 1]]):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) == 5


def test_texts_longer_than_a_chunk_hash_alike(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"word{i}" for i in range(3000))
    (_, _, data, offsets), = textpack.chunks(pa.array([text]))
    want = textpack.words(data, offsets, textpack.SPACED)
    monkeypatch.setattr(textpack, "CHUNK", 50)
    got = textpack.words(data, offsets, textpack.SPACED)
    assert all((a == b).all() for a, b in zip(want, got))


def test_a_marker_of_most_positives_is_not_taken_for_a_common_word():
    row = lambda i, toxic: np.array([7] * toxic + [1000 + i % 50, 9], dtype=np.int64)
    model = toxicity.fitted([row(i, True) for i in range(60)], [row(i, i % 10 == 0) for i in range(180)], 0.1)
    assert model.used[7] and model.weights[7] > 0 and not model.used[9]


def plain_ftrl(rows):
    """FTRL-proximal, one weight at a time."""
    z, n, bias = defaultdict(float), defaultdict(float), -1

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == bias else (quality.L1, quality.L2)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + l2)

    for epoch in range(quality.EPOCHS):
        for k in np.random.default_rng(quality.SEED + epoch).permutation(len(rows)):
            _, y, at, count = rows[k]
            x = {int(i): c / math.sqrt(max(sum(map(int, count)), 1)) for i, c in zip(at, count)} | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in n}, weight(bias)


def test_ftrl_equals_a_plain_one():
    docs, labels = make(80)
    rows = []
    for i, text, *_ in docs:
        a = np.frombuffer(text.encode(), np.uint8)
        rows.append((i, labels[i][1], *np.unique(quality.features(a, np.array([0, len(a)]))[0], return_counts=True)))
    model = quality.fitted(rows)
    want, bias = plain_ftrl(rows)
    assert math.isclose(model.bias, bias, rel_tol=1e-6) and all(abs(model.weights[i] - w) < 1e-5 for i, w in want.items() if i >= 0)


def plain_nnpu(positive, unlabelled, prior):
    """Non-negative PU descent, one row and one weight at a time; features are those that ``fitted`` uses."""
    s = lambda x: 1 / (1 + math.exp(-x))
    total, base = defaultdict(float), 0.0
    for model in range(toxicity.MODELS):
        rng = np.random.default_rng(toxicity.SEED + model)
        w, m, b, mb = defaultdict(float), defaultdict(float), math.log(prior / (1 - prior)), 0.0
        for _ in range(toxicity.EPOCHS):
            pos, unl = [positive[i] for i in rng.permutation(len(positive))], [unlabelled[i] for i in rng.permutation(len(unlabelled))]
            f = lambda row: b + sum(w[i] for i in row) / math.sqrt(1 + len(row))
            fp, fu = [f(r) for r in pos], [f(r) for r in unl]
            negative = sum(math.log1p(math.exp(x)) for x in fu) / len(fu) - prior * sum(math.log1p(math.exp(x)) for x in fp) / len(fp)
            gp = [prior * (s(x) / len(fp) if negative < 0 else (s(x) - 1) / len(fp) - s(x) / len(fp)) for x in fp]
            gu = [(-1 if negative < 0 else 1) * s(x) / len(fu) for x in fu]
            g = defaultdict(float)
            for row, d in [*zip(pos, gp), *zip(unl, gu)]:
                for i in row:
                    g[i] += d / math.sqrt(1 + len(row))
            for i in {*g, *w}:
                m[i] += 0.1 * (g[i] + toxicity.DECAY * w[i] - m[i])
                w[i] -= toxicity.RATE * m[i]
            mb += 0.1 * (sum(gp) + sum(gu) - mb)
            b -= toxicity.BIAS_RATE * mb
        for i in w:
            total[i] += w[i] / toxicity.MODELS
        base += b / toxicity.MODELS
    margins = [base + sum(total[i] for i in r) / math.sqrt(1 + len(r)) for r in unlabelled]
    return total, base - float(np.quantile(margins, 1 - toxicity.SHARE * prior))


def test_nnpu_equals_a_plain_one():
    rng = random.Random(2)
    row = lambda marks: np.unique(np.array(marks + [100 + rng.randrange(12) for _ in range(3)], dtype=np.int64))
    positive, unlabelled = [row([7]) for _ in range(20)], [row([7] if i % 10 == 0 else [9] if i % 9 == 0 else []) for i in range(50)]
    model = toxicity.fitted(positive, unlabelled, 0.15)
    keep = lambda rows: [[int(i) for i in r if model.used[i]] for r in rows]
    want, bias = plain_nnpu(keep(positive), keep(unlabelled), 0.15)
    assert math.isclose(model.bias, bias, rel_tol=1e-4, abs_tol=1e-4) and all(abs(model.weights[i] - w) < 1e-3 for i, w in want.items())


def test_the_sample_is_bounded_before_it_is_collected(spark, monkeypatch):
    docs, labels = make(300)
    again = [(3, f"other {i % 7} text", "en", "s", 1, 0.0) for i in range(500)]
    d, y = frames(spark, docs + again, labels)
    ids = labelled.training_labels(y, "quality")
    rows = labelled.sample_features(d, ids, quality.features)
    assert len(rows) == len({r[0] for r in rows}) == ids.count() and [r[0] for r in rows] == sorted(r[0] for r in rows)
    once = {r[0]: r[2].tolist() for r in rows}
    total = sum(len(r[2]) for r in rows)
    monkeypatch.setattr(labelled, "FEATURES", total // 2)
    fewer = labelled.sample_features(d, ids, quality.features)
    assert total / 4 < sum(len(r[2]) for r in fewer) <= total // 2 and all(once[r[0]] == r[2].tolist() for r in fewer)
