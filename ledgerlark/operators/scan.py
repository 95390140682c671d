"""Clusters, unions and containment along a group's order, for groups of any size: no window covers a whole large group.

Groups of up to ``most`` rows have one window each. A larger one is cut into slices of neighbouring values. Windows run within a slice; each slice's sum or maximum becomes a row, a second window over these few rows says what stands before
a slice, and that is added. Between such steps the large groups' rows, no others, are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.sources.shared import written

if TYPE_CHECKING:
    import pyarrow as pa

#: Rows of a group from which it is cut, and slices of a group at most.
MOST, SLICES = 500_000, 4096
SLICE = "_slice"


def heavy_groups(rows: DataFrame, most: int = MOST) -> DataFrame | None:
    """h of the groups of ``rows`` (g, ...) with more than ``most`` rows, which are fewer than rows / most; None if there are none."""
    heavy = rows.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("g").collect()
    return rows.sparkSession.createDataFrame([(r["g"],) for r in heavy], f"h {rows.schema['g'].dataType.simpleString()}") if heavy else None


def _of(rows: DataFrame, heavy: DataFrame, how: str) -> DataFrame:
    return rows.join(F.broadcast(heavy), F.col("g").eqNullSafe(F.col("h")), how)


def sliced(rows: DataFrame, by: str, most: int = MOST) -> DataFrame:
    """Large groups' rows (g, ...) with the slice of each, ascending with ``by``. The bounds, approximate quantiles of no more than ``SLICES`` slices a group, come to the driver, so that every later pass cuts alike."""
    largest = rows.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    n = max(2, min(SLICES, -(-largest // most)))
    found = rows.groupBy("g").agg(F.percentile_approx(F.col(by).cast("double"), [i / n for i in range(1, n)], 50 * n).alias("bounds")).collect()
    bounds = rows.sparkSession.createDataFrame([(r["g"], sorted(set(r["bounds"] or []))) for r in found], f"h {rows.schema['g'].dataType.simpleString()}, _bounds array<double>")
    below = F.size(F.filter("_bounds", lambda b: b <= F.col(by).cast("double")))
    return written(_of(rows, bounds, "left").withColumn(SLICE, F.coalesce(below, F.lit(0))).drop("h", "_bounds"), "slices")


def _before(rows: DataFrame, **parts: Column) -> DataFrame:
    """g and slice, with what all earlier slices of the group add up to: ``parts`` are (aggregate of a slice, aggregate of slices), by name."""
    of = rows.groupBy(F.col("g").alias("_g"), F.col(SLICE).alias("_s")).agg(*[one.alias(f"_{name}") for name, (one, _) in parts.items()])
    earlier = W.partitionBy("_g").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    return of.select("_g", "_s", *[over(F.col(f"_{name}")).over(earlier).alias(name) for name, (_, over) in parts.items()])


def _with(rows: DataFrame, before: DataFrame) -> DataFrame:
    return rows.join(before, F.col("g").eqNullSafe(F.col("_g")) & (F.col(SLICE) == F.col("_s"))).drop("_g", "_s")


def local(*order: Column | str) -> W:
    return W.partitionBy("g", SLICE).orderBy(*order)


def running_sum(rows: DataFrame, value: str, name: str, *order: Column | str) -> DataFrame:
    """Sliced rows with the sum of ``value`` up to each row of its group."""
    within = F.sum(value).over(local(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = _with(rows.withColumn("_within", within), _before(rows, _earlier=(F.sum(value), F.sum)))
    return written(whole.withColumn(name, F.col("_within") + F.coalesce("_earlier", F.lit(0))).drop("_within", "_earlier"), "sums")


def running_max(rows: DataFrame, value: str, name: str, *order: Column | str) -> DataFrame:
    """Sliced rows with the largest ``value`` of the rows before each one in its group, null for the first."""
    within = F.max(value).over(local(*order).rowsBetween(W.unboundedPreceding, -1))
    whole = _with(rows.withColumn("_within", within), _before(rows, _earlier=(F.max(value), F.max)))
    return written(whole.withColumn(name, F.greatest("_within", "_earlier")).drop("_within", "_earlier"), "maxima")


def clusters_within(values: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """``clusters`` of groups that are known to be small: one window each."""
    order = W.partitionBy("g").orderBy("v")
    starts = F.coalesce(F.col("v") - F.lag("v").over(order) > tolerance, F.lit(False)).cast("int")
    marked = values.withColumn("new", starts).withColumn("cluster", F.sum("new").over(order.rangeBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy("g", "cluster").agg(F.count("*").alias("n"), F.median("v").alias("middle"))


def _clusters_sliced(values: DataFrame, tolerance: float, most: int) -> DataFrame:
    counted = sliced(written(values.groupBy("g", "v").agg(F.count("*").alias("n")), "values"), "v", most)
    last = running_max(counted, "v", "_last", "v")  # of distinct ascending values the largest before a row is the one before it
    marked = last.withColumn("_new", F.coalesce(F.col("v") - F.col("_last") > tolerance, F.lit(False)).cast("long")).drop("_last")
    numbered = running_sum(marked, "_new", "cluster", "v").withColumn("_n", F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0))
    numbered = running_sum(numbered, "_n", "_to", "v")
    parts = numbered.groupBy("g", "cluster", SLICE).agg(F.sum("n").alias("n"), F.sum("_n").alias("_own"), F.min(F.col("_to") - F.col("_n")).alias("_from"))
    whole = W.partitionBy("g", "cluster")  # of a row for each slice that the cluster reaches
    parts = parts.select("g", "cluster", SLICE, F.sum("n").over(whole).alias("n"), F.sum("_own").over(whole).alias("_own"), F.min("_from").over(whole).alias("_from"))
    low, high = F.col("_from") + F.floor((F.col("_own") + 1) / 2), F.col("_from") + F.floor(F.col("_own") / 2) + 1
    wanted = parts.select(F.col("g").alias("_g"), F.col("cluster").alias("_c"), F.col(SLICE).alias("_s"), F.col("n").alias("_all"), low.alias("_low"), high.alias("_high"))
    met = numbered.join(wanted, F.col("g").eqNullSafe(F.col("_g")) & (F.col("cluster") == F.col("_c")) & (F.col(SLICE) == F.col("_s")))
    holds = lambda r: (F.col("_to") - F.col("_n") < F.col(r)) & (F.col(r) <= F.col("_to"))
    middle = (F.max(F.when(holds("_low"), F.col("v"))) + F.max(F.when(holds("_high"), F.col("v")))) / 2
    return met.groupBy("g", "cluster").agg(F.max("_all").alias("n"), middle.alias("middle"))


def clusters(values: DataFrame, tolerance: float = 8.0, most: int = MOST) -> DataFrame:
    """g, cluster, n, middle of ``values`` (g, v): sorted values whose gap to the one before is within the tolerance belong together; the middle is their median. Null values form a cluster with those next to them, and no middle
    counts them."""
    own = values.select("g", "v")
    heavy = heavy_groups(own, most)
    if heavy is None:
        return clusters_within(own, tolerance)
    return clusters_within(_of(own, heavy, "left_anti"), tolerance).unionByName(_clusters_sliced(_of(own, heavy, "left_semi"), tolerance, most))


def coverage_within(intervals: DataFrame) -> DataFrame:
    """``coverage`` of groups that are known to be small: one window each."""
    before = W.partitionBy("g").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("hi").over(before)
    return intervals.withColumn("add", F.greatest(F.lit(0.0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(reach, F.col("lo"))))).groupBy("g").agg(F.sum("add").alias("covered"))


def coverage(intervals: DataFrame, most: int = MOST) -> DataFrame:
    """g, covered: the length of the union of ``intervals`` (g, lo, hi). Each adds what reaches beyond the furthest end before it; in a large group the longest counts of those that begin together."""
    own = intervals.select("g", "lo", "hi")
    heavy = heavy_groups(own, most)
    if heavy is None:
        return coverage_within(own)
    longest = written(_of(own, heavy, "left_semi").groupBy("g", "lo").agg(F.max("hi").alias("hi")), "intervals")
    reached = running_max(sliced(longest, "lo", most), "hi", "_reach", "lo")
    add = F.greatest(F.lit(0.0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce("_reach", F.col("lo"))))
    return coverage_within(_of(own, heavy, "left_anti")).unionByName(reached.groupBy("g").agg(F.sum(add).alias("covered")))


def furthest(v: np.ndarray, distance: float) -> np.ndarray:
    """For each double the largest double whose difference from it, rounded as doubles are, is less than ``distance``. Differences rise with the other number, so a search by halves over the doubles in their order ends exactly there."""
    least = np.iinfo(np.int64).min

    def place(x: np.ndarray) -> np.ndarray:
        bits = x.view(np.int64)
        return np.where(bits < 0, least - bits, bits)

    def at(k: np.ndarray) -> np.ndarray:
        return np.where(k < 0, least - k, k).view(np.float64)

    with np.errstate(over="ignore"):
        low, high = place(v), place(np.nextafter(v + 2 * distance, np.inf))
        for _ in range(64):
            middle = (low >> 1) + (high >> 1) + (low & high & 1)
            near = at(middle) - v < distance
            low, high = np.where(near, middle, low), np.where(near, high, middle)
    return at(low)


def _reaches(distance: float) -> "Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]":
    def run(batches: "Iterator[pa.RecordBatch]") -> "Iterator[pa.RecordBatch]":
        import pyarrow as pa

        for batch in batches:
            v = np.ascontiguousarray(batch.column("v").to_numpy(zero_copy_only=False), np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(-furthest(-v, distance)), pa.array(furthest(v, distance))], names=[*batch.schema.names, "lo", "hi"])

    return run


def _neighbourhood(values: DataFrame, distance: float, least: int, summed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    own = values.select("g", "id", F.col("v").cast("double").alias("v")).filter("g is not null and abs(v) < double('infinity')")
    counted = own.groupBy("g", "v").agg(F.count("*").alias("n"))
    reached = counted.mapInArrow(_reaches(distance), f"g {counted.schema['g'].dataType.simpleString()}, v double, n long, lo double, hi double")
    mark = lambda at, kind, n: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"), n.alias("n"))
    none = F.lit(0).cast("long")
    marks = reached.select("g", "v", F.inline(F.array(mark("lo", 0, none), mark("v", 1, F.col("n")), mark("hi", 2, none))))  # an end before or after the values that are equal to it
    ends = summed(marks).filter("kind != 1")
    near = ends.groupBy(F.col("g").alias("_g"), F.col("v").alias("_v")).agg(F.sum(F.when(F.col("kind") == 2, F.col("_to")).otherwise(-F.col("_to"))).alias("n"))
    met = own.join(near, (F.col("g") == F.col("_g")) & (F.col("v") == F.col("_v"))).groupBy("g", "id").agg(F.sum("n").alias("n"))
    best = met.groupBy("g").agg(F.max(F.struct(F.col("n"), (-F.col("id")).alias("i"))).alias("b"))
    return best.select("g", (-F.col("b.i")).alias("anchor"), F.col("b.n").alias("n")).filter(F.col("n") >= least)


def _summed_within(marks: DataFrame) -> DataFrame:
    return marks.withColumn("_to", F.sum("n").over(W.partitionBy("g").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)))


def largest_neighbourhood_within(values: DataFrame, distance: float, least: int = 1) -> DataFrame:
    """``largest_neighbourhood`` of groups that are known to be small: one window each."""
    return _neighbourhood(values, distance, least, _summed_within)


def largest_neighbourhood(values: DataFrame, distance: float, least: int = 1, most: int = MOST) -> DataFrame:
    """g, anchor, n: of each group in ``values`` (g, id, v) the value with the most values nearer than ``distance`` (itself included), the smallest id on ties, if
    there are at least ``least``. Values near one are neighbours in their order: a running sum up to the furthest of them, less the one before the first, counts them, so no value meets another."""
    def summed(marks: DataFrame) -> DataFrame:
        marks = written(marks, "neighbours")
        heavy = heavy_groups(marks, most)
        if heavy is None:
            return _summed_within(marks)
        large = running_sum(sliced(_of(marks, heavy, "left_semi"), "at", most), "n", "_to", "at", "kind").drop(SLICE)
        return _summed_within(_of(marks, heavy, "left_anti")).unionByName(large)

    return _neighbourhood(values, distance, least, summed)


def containing(points: DataFrame, intervals: DataFrame, most: int = MOST) -> DataFrame:
    """g, id, k: for each point (g, id, v) the first interval (g, k, lo, hi), by k, that holds it, ends included; points without one are left out.

    Intervals may be of any lengths and overlap as they like. A group's ends are numbered in their order, by a running sum, and a point stands at an end's number or between two. An interval of numbers is cut into cells of powers of two, no more
    than two of each size; a cell keeps the first interval that covers it, and a point looks into the one cell of each size that it is in. So what is sent grows with the logarithm of a group's ends, never with their lengths or with how
    many overlap. Places that have points look, each once. Cells of a large group that are so wide that it has no more than about ``SLICES`` of a size are sent to all tasks, as a wide cell's looks would be one task's; these are
    fewer than a group's rows / most * 2 * SLICES. Any other cell holds no more than a group's places / SLICES."""
    own = intervals.filter("lo <= hi")
    ends = own.select("g", F.explode(F.array(F.col("lo").cast("double"), F.col("hi").cast("double"))).alias("v")).distinct().withColumn("_end", F.lit(1).cast("long"))
    places = points.select("g", F.col("v").cast("double").alias("v")).filter("v is not null").distinct().withColumn("_end", F.lit(0).cast("long"))
    both = written(ends.unionByName(places).groupBy("g", "v").agg(F.max("_end").alias("_end")), "ends")
    heavy = heavy_groups(both, most)
    small = both if heavy is None else _of(both, heavy, "left_anti")
    ranked = small.withColumn("_rank", F.sum("_end").over(W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)))
    if heavy is not None:
        ranked = ranked.unionByName(running_sum(sliced(_of(both, heavy, "left_semi"), "v", most), "_end", "_rank", "v").drop(SLICE))
    at = ranked.select(F.col("g").alias("_g"), F.col("v").alias("_v"), (2 * F.col("_rank") + F.when(F.col("_end") == 1, 0).otherwise(1)).alias("_at"))  # an end at an even number, between two at the odd one
    at = written(at, "ranks")
    sizes = F.sequence(F.lit(0), F.ceil(F.log2(F.col("_top") + 2)).cast("int"))
    top = at.groupBy(F.col("_g").alias("_t")).agg(F.max("_at").alias("_top"))

    def placed(rows: DataFrame, value: str, name: str) -> DataFrame:
        return rows.join(at, F.col("g").eqNullSafe(F.col("_g")) & (F.col(value).cast("double") == F.col("_v"))).withColumnRenamed("_at", name).drop("_g", "_v")

    spans = placed(placed(own.select("g", "k", "lo", "hi"), "lo", "_a"), "hi", "_b").join(top, F.col("g").eqNullSafe(F.col("_t")))
    left = lambda j: F.ceil(F.col("_a") / F.pow(F.lit(2.0), j)).cast("long")
    right = lambda j: F.floor((F.col("_b") + 1) / F.pow(F.lit(2.0), j)).cast("long")
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    cells = F.flatten(F.transform(sizes, lambda j: F.array(
        F.when((left(j) < right(j)) & odd(left(j)), F.struct(j.alias("j"), left(j).alias("c"))), F.when((left(j) < right(j)) & odd(right(j)), F.struct(j.alias("j"), (right(j) - 1).alias("c")))
    )))
    wide = lambda j: (F.col("_top") > 2 * most) & (F.pow(F.lit(2.0), j) * SLICES >= F.col("_top"))
    first = spans.select("g", "k", "_top", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).withColumn("_wide", wide(F.col("x.j")))
    first = first.groupBy(F.col("g").alias("_g"), F.col("x.j").alias("_j"), F.col("x.c").alias("_c"), "_wide").agg(F.min("k").alias("k"))
    found = written(placed(points.select("g", "id", "v"), "v", "_p"), "places")
    looks = found.select("g", "_p").distinct().join(top, F.col("g").eqNullSafe(F.col("_t")))  # points at one place look once
    looks = looks.select("g", "_p", "_top", F.explode(sizes).alias("_size")).withColumn("_cell", F.floor(F.col("_p") / F.pow(F.lit(2.0), F.col("_size"))).cast("long"))
    looks = looks.select("g", "_p", "_size", "_cell", wide(F.col("_size")).alias("_of_wide"))
    same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("_size") == F.col("_j")) & (F.col("_cell") == F.col("_c"))
    met = looks.filter("not _of_wide").join(first.filter("not _wide"), same).unionByName(looks.filter("_of_wide").join(F.broadcast(first.filter("_wide")), same))
    best = met.groupBy(F.col("g").alias("_g"), F.col("_p").alias("_at")).agg(F.min("k").alias("k"))
    return found.join(best, F.col("g").eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_at"))).groupBy("g", "id").agg(F.min("k").alias("k"))
