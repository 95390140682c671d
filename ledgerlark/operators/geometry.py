"""Geometric operators on numbers by group: clusters, unions of intervals, neighbours within a distance, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.operators.scan import clusters, clusters_within, containing, coverage, coverage_within, largest_neighbourhood, largest_neighbourhood_within

__all__ = ["boundaries", "bucketed_rules", "chunked", "clusters", "containing", "coverage", "grid", "joined_words", "largest_neighbourhood", "recovered_rows", "ruled_table", "skew"]


def boundaries(anchors: DataFrame, rules: DataFrame, margin: float = 4.0, least: float = 0.3) -> DataFrame:
    """g, lo, hi, y: for each pair of consecutive anchors (g, v) the rule (g, y, covered) between them, ``margin`` clear of both and covering more than
    ``least``, with the largest cover, then nearest to the middle, then smallest. Only groups in which every pair has one. A rule lies between one pair only: the last anchor below it, found by one running
    window, says which; no rule meets another pair."""
    pairs = anchors.select("g", F.col("v").alias("lo"), F.lead("v").over(W.partitionBy("g").orderBy("v")).alias("hi")).filter("hi is not null")
    both = anchors.select("g", F.col("v").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("covered")).unionByName(
        rules.filter(F.col("covered") > least).select("g", F.col("y").alias("at"), F.lit(0).alias("kind"), F.col("covered").cast("double").alias("covered"))
    )
    below = F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(W.partitionBy("g").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = both.withColumn("low", below).filter("kind = 0 and low is not null").select(F.col("g").alias("h"), "low", F.col("at").alias("y"), "covered")
    inside = (F.col("y") > F.col("lo") + margin) & (F.col("y") < F.col("hi") - margin)
    met = pairs.join(placed, (F.col("g") == F.col("h")) & (F.col("lo") == F.col("low")) & inside, "left")
    rank = F.struct(F.col("covered"), (-F.abs(F.col("y") - (F.col("lo") + F.col("hi")) / 2)).alias("near"), (-F.col("y")).alias("first"))
    best = met.groupBy("g", "lo", "hi").agg(F.max_by("y", F.when(F.col("y").isNotNull(), rank)).alias("y"))
    whole = best.withColumn("all", F.bool_and(F.col("y").isNotNull()).over(W.partitionBy("g")))
    return whole.filter("all").select("g", "lo", "hi", "y")


def ruled_table(rules: DataFrame, pages: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """g, xs, ys of pages (g, width, height) with a ruled table among their rules (g, id, x0, y0, x1, y1), as arrays: at least six vertical rules longer than 15 % of the page whose upper ends lie within 1.2 % of its height of
    one of them (the one with the most; the smallest id on ties), at six places or more over half the width; the horizontal rules between their ends that span half of that, with both ends."""
    page = pages.select(F.col("g").alias("p"), "width", "height")
    own = rules.join(page, F.col("g") == F.col("p")).select("g", "id", "x0", "x1", "y0", "y1", F.least("y0", "y1").alias("top"), F.greatest("y0", "y1").alias("bottom"), "width", "height")
    long = own.filter((F.abs(F.col("x0") - F.col("x1")) < 1) & (F.col("bottom") - F.col("top") > 0.15 * F.col("height")))
    scaled = long.select("g", "id", (F.col("top") / (0.012 * F.col("height"))).alias("v"))
    anchor = largest_neighbourhood_within(scaled, 1.0, 6).select(F.col("g").alias("h"), "anchor")
    first = long.join(anchor, (F.col("g") == F.col("h")) & (F.col("id") == F.col("anchor"))).select(F.col("g").alias("h"), F.col("top").alias("at"))
    group = long.join(first, (F.col("g") == F.col("h")) & (F.abs(F.col("top") - F.col("at")) < 0.012 * F.col("height")))
    sides = group.groupBy("g").agg(F.median("top").alias("top"), F.min("bottom").alias("bottom"), F.max("width").alias("width"))
    middles = lambda values: clusters_within(values, tolerance).groupBy("g").agg(F.array_sort(F.collect_list("middle")).alias("at"))
    xs = middles(group.select("g", F.col("x0").cast("double").alias("v"))).select(F.col("g").alias("x"), F.col("at").alias("xs"))
    span = F.element_at("xs", -1) - F.get("xs", F.lit(0))
    table = sides.join(xs, F.col("g") == F.col("x")).filter((F.size("xs") >= 6) & (span >= 0.5 * F.col("width"))).select(F.col("g").alias("t"), "xs", F.col("top").alias("upper"), F.col("bottom").alias("lower"), span.alias("span"))
    level = own.filter(F.abs(F.col("y0") - F.col("y1")) < 1).join(table, F.col("g") == F.col("t"))
    level = level.filter((F.abs(F.col("x0") - F.col("x1")) > 0.5 * F.col("span")) & F.col("y0").between(F.col("upper") - 8, F.col("lower") + 8)).select("g", F.col("y0").cast("double").alias("v"))
    ends = table.select(F.col("t").alias("g"), F.explode(F.array(F.col("upper").cast("double"), F.col("lower").cast("double"))).alias("v"))
    ys = middles(level.unionByName(ends)).select("g", F.col("at").alias("ys"))
    return table.join(ys, F.col("t") == F.col("g")).filter(F.size("ys") >= 3).select("g", "xs", "ys")


def recovered_rows(table: DataFrame, anchors: DataFrame, rules: DataFrame) -> DataFrame:
    """g, ys of ruled tables (g, xs, ys, formula) whose rows' numbers stand at ``anchors`` (g, v): the header's upper edge, with a formula row also its own, where the body starts, one boundary between each two
    numbers, from the horizontal rules (g, y, lo, hi) within the table, and the lower edges beyond the last number. With fewer than two numbers the edges stay; where a boundary has no rule, the table is left out."""
    start = F.get("ys", F.when(F.col("formula"), F.lit(2)).otherwise(F.lit(1)))
    own = table.select(F.col("g").alias("t"), "xs", "ys", "formula", start.alias("start"), F.get("xs", F.lit(0)).alias("left"), F.element_at("xs", -1).alias("right"))
    many = anchors.groupBy("g").agg(F.count("*").alias("n"), F.max("v").alias("last")).select(F.col("g").alias("a"), "n", "last")
    own = own.join(many, F.col("t") == F.col("a"), "left")
    cut = rules.join(own, (F.col("g") == F.col("t")) & (F.col("y") > F.col("start")) & (F.col("y") < F.element_at("ys", -1)))
    cut = cut.select("g", "y", F.greatest("left", F.least("lo", "hi")).alias("lo"), F.least("right", F.greatest("lo", "hi")).alias("hi"), (F.col("right") - F.col("left")).alias("span"))
    share = bucketed_rules(cut.select("g", "y", "lo", "hi")).join(cut.groupBy(F.col("g").alias("h")).agg(F.max("span").alias("span")), F.col("g") == F.col("h"))
    between = boundaries(anchors, share.select("g", "y", (F.col("covered") / F.col("span")).alias("covered"))).groupBy(F.col("g").alias("b")).agg(F.array_sort(F.collect_list("y")).alias("between"))
    found = own.join(between, F.col("t") == F.col("b"), "left").filter((F.coalesce("n", F.lit(0)) < 2) | F.col("between").isNotNull())
    head = F.slice("ys", F.lit(1), F.when(F.col("formula"), F.lit(2)).otherwise(F.lit(1)))
    tail = F.filter("ys", lambda y: y > F.col("last") + 5)
    return found.select(F.col("t").alias("g"), F.when(F.coalesce("n", F.lit(0)) < 2, F.col("ys")).otherwise(F.concat(head, F.array("start"), F.coalesce("between", F.array().cast("array<double>")), tail)).alias("ys"))


def skew(segments: DataFrame, most: float = 7.0, least: float = 0.15) -> DataFrame:
    """g, angle: by how many degrees a page leans, the median angle of its line segments (g, x0, y0, x1, y1) that are within ``most`` degrees of level; 0 if that is no more than ``least``. Pages
    without such a segment are left out."""
    angle = F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))
    own = segments.select("g", angle.alias("angle")).filter(F.abs("angle") <= most).groupBy("g").agg(F.median("angle").alias("angle"))
    return own.select("g", F.when(F.abs("angle") > least, F.col("angle")).otherwise(0.0).alias("angle"))


def grid(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """g, r, c, x0, x1, y0, y1: the cells between consecutive xs (g, v) and consecutive ys (g, v), row by row. Rows and columns meet within a group only."""
    def spans(values: DataFrame, a: str, b: str, no: str) -> DataFrame:
        order = W.partitionBy("g").orderBy("v")
        return values.select("g", F.col("v").alias(a), F.lead("v").over(order).alias(b), (F.row_number().over(order) - 1).alias(no)).filter(F.col(b).isNotNull())

    return spans(ys, "y0", "y1", "r").join(spans(xs, "x0", "x1", "c"), "g").select("g", "r", "c", "x0", "x1", "y0", "y1")


def bucketed_rules(rules: DataFrame, width: float = 6.0) -> DataFrame:
    """g, y, covered: horizontal rules (g, y, lo, hi) gathered at multiples of ``width`` (halves to even) with the length that they cover."""
    own = rules.select("g", "lo", "hi", (F.bround(F.col("y") / width) * width).alias("y"))
    keyed = own.select(F.struct("g", "y").alias("g"), "lo", "hi")
    return coverage_within(keyed).select("g.g", "g.y", "covered")


def joined_words(words: DataFrame, separator: str = " ") -> DataFrame:
    """cell, text of ``words`` (cell, pos, text, conf): the words in order, and the least confidence, 0 without any."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return words.groupBy("cell").agg(F.array_join(ordered, separator).alias("text"), F.coalesce(F.min("conf"), F.lit(0.0)).alias("conf"))


def chunked(cells: DataFrame, columns: int) -> DataFrame:
    """g, r, cells: a flat list (g, i, cell) cut into rows of ``columns``."""
    row = F.floor(F.col("i") / columns)
    return cells.groupBy("g", row.alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "cell"))), lambda x: x["cell"]).alias("cells"))
