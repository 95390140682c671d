import hashlib
import math
import re
import zlib
from collections import Counter

from ledgerlark.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, score string, row long, part string, bucket int"


def docs(spark, data):
    return spark.createDataFrame([(i, t, "x", 1, "p", 2) for i, t in data], SCHEMA)


def runs(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(data, target, percent=10, least=20, longest=1):
    s, t = (Counter(b for _, text in rows for b in runs(text, longest)[1]) for rows in (data, target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for i, text in data:
        n, found = runs(text, longest)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


DATA = [(i, " ".join(f"W{(i * j) % 89}{'é' * (j % 3)}-x{j % 7}" for j in range(i % 50))) for i in range(400)]
TARGET = [(1, "w3 x4 w5é X6 " * 30), (2, None), (3, "")]


def check(spark, data, target, **parameters):
    got = sorted((tuple(r) for r in resample.resampled(docs(spark, data), docs(spark, target), **parameters).collect()), key=repr)
    assert got == brute(data, target, **parameters)
    return got


def test_against_brute_force(spark):
    got = check(spark, DATA, TARGET)
    assert sum(r[4] is not None for r in got) > 10
    check(spark, DATA, TARGET, longest=3)
    check(spark, DATA, TARGET, percent=100, least=0)


def test_edges(spark):
    odd = [(None, "a b"), (None, None), (7, None), (8, ""), (9, "..."), (10, "z" * 500 + " " + "é" * 60 + " b"), (11, " x\x85y Ünï ABC"), (12, "word " * 60_000)]
    check(spark, odd + DATA[:60], TARGET, percent=50, least=1)
    check(spark, [], TARGET)
    check(spark, DATA[:40], [])
    check(spark, [(1, None)], [(1, None)])


def test_a_score_that_many_rows_share(spark):
    same = [(5, "one two three " * 10)] * 3000 + DATA[:100]
    got = check(spark, same, TARGET, percent=70)
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1))
    assert check(spark, [(None, "one two " * 20)] * 50, TARGET, percent=50)[-1][4] is None


def test_drawn_documents_keep_their_columns(spark):
    out = resample.drawn_documents(docs(spark, DATA), docs(spark, TARGET))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r[0] for r in brute(DATA, TARGET) if r[4])
