import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import geometry, scan


def clustered(rows, tolerance):
    out = {}
    for g in {g for g, _ in rows}:
        values = sorted((v for h, v in rows if h == g), key=lambda v: (v is not None, v or 0))
        k, held = 0, []
        for i, v in enumerate(values):
            if i and v is not None and values[i - 1] is not None and v - values[i - 1] > tolerance:
                k += 1
            held.append((k, v))
        for c in range(k + 1):
            own = [v for x, v in held if x == c]
            known = [v for v in own if v is not None]
            out[g, c] = (len(own), statistics.median(known) if known else None)
    return out


def made(seed, n, groups, spread):
    r = random.Random(seed)
    return [(r.choice(groups), float(r.randrange(spread))) for _ in range(n)]


@pytest.mark.parametrize("most", [40, 10_000])
def test_clusters(spark, most):
    rows = made(1, 600, [1, 1, 1, 1, 2, None], 900) + [(3, 5.0)] * 300 + [(4, None), (4, None), (4, 7.0), (5, None)]
    got = {(r.g, r.cluster): (r.n, r.middle) for r in scan.clusters(spark.createDataFrame(rows, "g long, v double"), 4.0, most).collect()}
    assert got == clustered(rows, 4.0)
    assert scan.clusters(spark.createDataFrame([], "g long, v double")).count() == 0


def covered(rows):
    out = {}
    for g in {g for g, *_ in rows}:
        total, reach = 0.0, None
        for lo, hi in sorted((lo, hi) for h, lo, hi in rows if h == g):
            total += max(0.0, hi - (lo if reach is None else max(lo, reach)))
            reach = hi if reach is None else max(reach, hi)
        out[g] = total
    return out


@pytest.mark.parametrize("most", [50, 10_000])
def test_coverage(spark, most):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 2]), float(lo), float(lo + r.choice([0, 1, 5, 400]))) for lo in (r.randrange(2000) for _ in range(500))] + [(3, 1.0, 1.0), (4, 5.0, 2.0)]
    got = {r.g: r.covered for r in scan.coverage(spark.createDataFrame(rows, "g long, lo double, hi double"), most).collect()}
    assert got == covered(rows)


@pytest.mark.parametrize("most", [30, 10_000])
def test_containing(spark, most):
    r = random.Random(3)
    spans = [(r.choice([1, 1, 2, None]), k, lo, lo + r.choice([0.0, 1.0, 1.5, 30.0, 5e3, 1e6])) for k, lo in ((k, r.uniform(-50, 50) if k % 3 else float(r.randrange(-50, 50))) for k in range(120))] + [(1, 500, 3.0, 1.0)]
    points = [(r.choice([1, 2, 3, None]), i, float(r.randrange(-60, 80)) if i % 2 else r.uniform(-60, 2e6)) for i in range(200)] + [(1, 900, None), (1, 901, spans[0][3])]
    want = {}
    for g, i, v in points:
        found = [k for h, k, lo, hi in spans if h == g and v is not None and lo <= v <= hi]
        if found:
            want[g, i] = min(found)
    got = {(r.g, r.id): r.k for r in scan.containing(spark.createDataFrame(points, "g long, id long, v double"), spark.createDataFrame(spans, "g long, k long, lo double, hi double"), most).collect()}
    assert got == want
    assert geometry.containing is scan.containing


def test_no_slice_has_more_than_its_share(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("g"), (F.pow(F.col("id").cast("double"), 2)).alias("v"))
    sizes = [r["count"] for r in scan.sliced(rows, "v", 1000).groupBy(scan.SLICE).count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 1500


def test_what_is_sent_is_bounded(spark):
    """Intervals a million long, all over one another: cells stay within two of each size."""
    n = 400
    one = F.pmod("id", F.lit(1)).alias("g")
    spans = spark.range(n).select(one, F.col("id").alias("k"), F.col("id").cast("double").alias("lo"), (F.col("id") + 1e6).alias("hi"))
    points = spark.range(n).select(one, "id", (F.col("id") + 0.5).alias("v"))
    found = scan.containing(points, spans)
    assert {r.k for r in found.collect()} == {0}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_neighbourhoods_count_without_pairs(spark):
    """Equal to counting every pair, at differences that rounding decides, in cut groups too; and a group of 200,000 near values isn't paired: which would be 4 * 10^10 pairs."""
    r = random.Random(11)
    rows = [(g, i, round(900 + r.randrange(4000) / 100, 2)) for g in ("a", "b") for i in range(300)] + [("a", 7, 905.01), ("c", 1, 0.1), ("c", 2, 0.4), ("c", 3, 0.7), ("c", 4, -0.0), ("c", 5, 0.0)]
    rows += [("d", 1, float("nan")), ("d", 2, None), ("d", 3, float("inf")), (None, 4, 1.0)] + [("e", i, 1e17 + 16 * i) for i in range(5)] + [("f", i, v) for i, v in enumerate((-2.5, 1e-300, 0.0, -1e-17))]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    for distance in (0.3, 40.0):
        want = {}
        for g in "abcef":
            own = [(i, v) for h, i, v in rows if h == g]
            n = {}
            for i, v in own:
                n[i] = n.get(i, 0) + sum(abs(v - w) < distance for _, w in own)
            want[g] = min((-k, i) for i, k in n.items())
        for got in (scan.largest_neighbourhood(df, distance), scan.largest_neighbourhood(df, distance, most=100)):
            assert {x.g: (-x.n, x.anchor) for x in got.collect()} == want
    many = spark.range(200_000).select(F.lit(1).alias("g"), "id", (F.col("id") / 200_000).alias("v"))
    assert [tuple(x) for x in scan.largest_neighbourhood(many, 2.0, most=50_000).collect()] == [(1, 0, 200_000)]


def test_no_task_takes_a_wide_cell(spark):
    """Before, every point of a group met in the one task of its widest cell; now no join of looks deals more than a share of the places to one key, and points at one place look once."""
    points = spark.range(4000).selectExpr("1 as g", "id", "cast(id % 1000 as double) as v")
    spans = spark.range(500).selectExpr("1 as g", "id as k", "cast(500 - id as double) as lo", "cast(500 + id as double) as hi")
    df = scan.containing(points, spans, 100)
    got = {r.id: r.k for r in df.collect()}
    assert got == {i: abs(i % 1000 - 500) for i in range(4000) if abs(i % 1000 - 500) < 500}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and plan.count("Generate explode(sequence(0") == 2 and "Aggregate [g#" in plan
