"""Pages as boxes: rules from runs of dark pixels, and text in reading order from the boxes of words. A page is of bounded size (readers bound its pixels), so windows and groups are by page."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd

#: Gaps that are closed are shorter, in pixels, along rows and along columns; a rule is at least LEAST pixels and 1 / SHARE of the page long, and SLENDER times as long as thick.
CLOSED_ACROSS, CLOSED_DOWN, LEAST, SHARE, SLENDER = 12, 8, 30, 30, 5
PARTS = "g long, across boolean, first long, last long, lo long, hi long"


def joined_parts(line: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The part of each run (sorted by line and lo, apart within a line): runs of neighbouring lines that touch, corners included, belong together."""
    up = np.arange(len(line))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    starts = np.searchsorted(line, line - 1), np.searchsorted(line, line - 1, "right")
    for i in range(len(line)):
        a = starts[0][i] + int(np.searchsorted(hi[starts[0][i] : starts[1][i]], lo[i]))
        while a < starts[1][i] and lo[a] <= hi[i]:
            x, y = top(int(a)), top(i)
            up[max(x, y)] = min(x, y)
            a += 1
    return np.array([top(i) for i in range(len(line))], dtype=np.int64)


def _parts(key: tuple, rows: "pd.DataFrame") -> "pd.DataFrame":
    rows = rows.sort_values(["line", "lo"])
    part = joined_parts(*(rows[c].to_numpy() for c in ("line", "lo", "hi")))
    boxes = rows.groupby(part).agg(first=("line", "min"), last=("line", "max"), lo=("lo", "min"), hi=("hi", "max"))
    return boxes.assign(g=key[0], across=key[1])[["g", "across", "first", "last", "lo", "hi"]]


def grid_lines(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """g, id, x0, y0, x1, y1: the long rules of pages (g, pixels_x, pixels_y, width, height), in page units, as ``geometry.ruled_table`` takes them. ``runs`` (g, across, line, lo, hi) are the dark pixels: from lo to before hi of a pixel row
    (``across``) or column. Runs of a line with a short gap between them are one; what is long enough then is joined with what touches it in the next line; a slender part is a rule through its middle."""
    page = pages.select(F.col("g").alias("p"), "pixels_x", "pixels_y", "width", "height")
    order = W.partitionBy("g", "across", "line").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    closed = F.when(F.col("across"), CLOSED_ACROSS).otherwise(CLOSED_DOWN)
    starts = runs.filter("lo < hi").withColumn("_new", F.coalesce(F.col("lo") - reach >= closed, F.lit(False)).cast("int"))
    whole = starts.withColumn("_k", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).groupBy("g", "across", "line", "_k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    least = F.greatest(F.lit(LEAST), F.floor(F.when(F.col("across"), F.col("pixels_x")).otherwise(F.col("pixels_y")) / SHARE))
    long = whole.join(page.select("p", "pixels_x", "pixels_y"), F.col("g") == F.col("p")).filter(F.col("hi") - F.col("lo") >= least)
    kept = long.select(*[F.col(c).cast("boolean" if c == "across" else "long").alias(c) for c in ("g", "across", "line", "lo", "hi")])
    parts = kept.groupBy("g", "across").applyInPandas(_parts, PARTS).join(page, F.col("g") == F.col("p"))
    thick, middle = F.col("last") - F.col("first") + 1, (F.col("first") + F.col("last") + 1) / 2
    rules = parts.filter((F.col("hi") - F.col("lo") >= least) & (F.col("hi") - F.col("lo") > SLENDER * thick))
    sx, sy = F.col("width") / F.col("pixels_x"), F.col("height") / F.col("pixels_y")
    side = lambda a, b, scale: F.when(F.col("across"), a).otherwise(b) * scale
    rules = rules.select("g", side(F.col("lo"), middle, sx).alias("x0"), side(middle, F.col("lo"), sy).alias("y0"), side(F.col("hi"), middle, sx).alias("x1"), side(middle, F.col("hi"), sy).alias("y1"))
    return rules.select("g", (F.row_number().over(W.partitionBy("g").orderBy("y0", "x0", "y1", "x1")) - 1).cast("long").alias("id"), "x0", "y0", "x1", "y1")


def _islands(rows: DataFrame, within: tuple[str, ...], lo: str, hi: str, gap: Column, name: str) -> DataFrame:
    """``rows`` numbered by the stretches that their intervals cover, a new one where ``gap`` or more is free."""
    order = W.partitionBy(*within).orderBy(lo, hi, "id")
    reach = F.max(hi).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.coalesce(F.col(lo) - reach >= gap, F.lit(False)).cast("int"))
    return marked.withColumn(name, F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def reading_order(words: DataFrame, band: float = 1.5, gutter: float = 2.0) -> DataFrame:
    """g, text of pages of words (g, id, x0, y0, x1, y1, text): cut into bands where at least ``band`` heights of a word are free from side to side, each band into columns where ``gutter`` heights are free from top to bottom, each column into
    lines of words whose upper halves overlap. Lines are joined by a line end, columns and bands by an empty line. The height is the page's median. Words without a text or with a null coordinate are left out; equal boxes stand by id."""
    sound = words.filter(" and ".join(f"{c} is not null" for c in ("g", "x0", "y0", "x1", "y1")) + " and trim(text) != ''")
    tall = sound.withColumn("_h", F.percentile(F.col("y1") - F.col("y0"), 0.5).over(W.partitionBy("g")))
    rows = _islands(tall, ("g",), "y0", "y1", band * F.col("_h"), "_band")
    rows = _islands(rows, ("g", "_band"), "x0", "x1", gutter * F.col("_h"), "_column")
    rows = _islands(rows.withColumn("_half", (F.col("y0") + F.col("y1")) / 2), ("g", "_band", "_column"), "y0", "_half", F.lit(0.0), "_line")
    joined = lambda c, x, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, F.col(c).alias("_t")))), lambda v: v["_t"]), x)
    lines = rows.groupBy("g", "_band", "_column", "_line").agg(joined("text", " ", ("x0", "id")).alias("_t"))
    columns = lines.groupBy("g", "_band", "_column").agg(joined("_t", "\n", ("_line",)).alias("_t"))
    return columns.groupBy("g").agg(joined("_t", "\n\n", ("_band", "_column")).alias("text"))
