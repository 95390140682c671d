import re
from collections import defaultdict

import pytest

from ledgerlark.llm import mixing


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, source string, size string, _copies int")


def water(sizes, total):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), total
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] >= 2 * sizes[s]]
        if not over:
            return goal | {s: unit * weight[s] for s in open_}
        for s in over:
            goal[s] = 2 * sizes[s]
            open_.discard(s)
            left -= goal[s]
    return goal


def seats(goal, n):
    got = dict.fromkeys(goal, 0)
    for _ in range(n):
        best = min(got, key=lambda s: (-goal[s] / (2 * got[s] + 1), s is None, s or ""))
        got[best] += 1
    return got


DATA = [(i, " ".join(["w"] * (i * 7 % 61)), ("b", "a", None, "src10", "src9", "a")[i % 6], "x", 7) for i in range(900)]


def test_against_step_by_step_apportionment(spark):
    out = mixing.mix(rows(spark, DATA)).collect()
    sizes = defaultdict(int)
    for _, text, source, *_ in DATA:
        sizes[source] += len(re.findall(mixing.WORD, text))
    goal = water(sizes, 1.5 * sum(sizes.values()))
    want = seats(goal, round(sum(goal.values()) / mixing.BLOCK))
    taken = defaultdict(int)
    for r in out:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == sizes[r.source] and r.blocks == want[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in goal:
        assert taken[s] == min(want[s] * mixing.BLOCK, 2 * sizes[s])
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(rows(spark, DATA[::-1])).collect()), key=repr)


def test_shard_quotas_add_up(spark):
    quota = mixing.quotas(mixing.targets(mixing.sized(rows(spark, DATA), 1)))
    want = {r.source: r.blocks for r in quota.collect()}
    got, by_shard = defaultdict(int), defaultdict(int)
    for r in mixing.shard_quotas(quota, 7).collect():
        got[r.source] += r.blocks
        by_shard[r.shard] += r.blocks
    assert got == want and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_edges(spark):
    data = [(None, None, None, "x", 7), (1, "", "a", "x", 7), (1, "", "a", "x", 7), (2, "one", "b", "x", 7), (3, "w " * 50_000, "b", "x", 7)]
    out = mixing.mix(rows(spark, data)).collect()
    assert len(out) == 5 and sum(r.taken for r in out) == pytest.approx(1.5 * 50_001, abs=16)
    assert mixing.mix(rows(spark, [])).count() == 0 and mixing.mixed_documents(rows(spark, [])).count() == 0
    none = mixing.mix(rows(spark, data[:3])).collect()
    assert [r.taken for r in none] == [0, 0, 0] and [r.target for r in none] == [0, 0, 0]


def test_mixed_documents_repeat_rows(spark):
    docs = rows(spark, DATA)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    for r in mixing.mix(docs).collect():
        assert got[r.doc_id] == (int(r.taken / r.size + 0.5) if r.size else 0)
