"""Search and pages that don't read or sort everything.

Search: stored rows are laid out in parts by their order, and an index says which three-letter runs (trigrams) each part holds. A query's runs between wildcards name the parts that can hold it; only these are read, and LIKE decides. Pages:
counts per range of the sort columns tell which range holds a page, and only that range is sorted.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import ascii_lower, let
from ledgerlark.operators import store

#: Rows of a part, folders of the index, and folders of the rows at most.
PART_ROWS, BUCKETS, RUNS = 4096, 64, 512
#: Ranges that a column is cut into, rows drawn to find them, and rows that are sorted in one go.
RANGES, DRAWN, SORTED = 64, 4096, 100_000


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters, ASCII letters lower-cased. The characters are split once for a text: within a lambda they would be split again for each of them."""
    def made(chars: Column) -> Column:
        return F.transform(F.slice(chars, F.lit(1), F.greatest(F.lit(0), F.size(chars) - 2)), lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)))

    return F.coalesce(F.array_distinct(let(F.split(ascii_lower(text), ""), made)), F.array().cast("array<string>"))


def query_trigrams(query: str) -> list[str]:
    """The trigrams that every match holds: those of the runs between the wildcards % and _ ."""
    low = query.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return sorted({run[i : i + 3] for run in re.split("[%_\x01]", low) for i in range(len(run) - 2)})


def write_indexed(invoices: DataFrame, folder: str, order: tuple[str, ...] = ("created_at", "invoice_id"), columns: tuple[str, ...] = store.SEARCHED, part_rows: int = PART_ROWS) -> None:
    """The invoices in parts of about ``part_rows`` rows along ``order``, so that what was saved together stands together, and the index of their trigrams. Null texts have none. Up to ``RUNS`` parts have a folder each; of more parts, runs
    of neighbours share one, so that files grow in size and not in number, and a file's row groups, ascending by part, are skipped by their bounds."""
    spark = invoices.sparkSession
    parts = max(1, -(-invoices.count() // part_rows))
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a row's place in its task
    at = F.lit(0) if parts <= RUNS else F.floor(inner / part_rows)
    placed = invoices.repartitionByRange(min(parts, RUNS), *order).sortWithinPartitions(*order).withColumn("run", F.spark_partition_id()).withColumn("part", F.col("run").cast("long") * F.lit(1 << 32) + at)
    placed.write.partitionBy("run").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    rows.groupBy("run", "part").agg(F.count("*").alias("n")).write.parquet(f"{folder}/parts")
    texts = rows.select("run", "part", F.explode(F.array(*columns)).alias("text")).filter("text is not null")
    found = texts.select("run", "part", F.explode(trigrams(F.col("text"))).alias("gram")).distinct()
    bucketed = found.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
    bucketed.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/grams")


@dataclass
class Found:
    """What a search gives: its rows, and how many parts of how many are read for them."""

    rows: DataFrame
    parts: int
    of: int


def indexed_search(spark: SparkSession, folder: str, query: str, columns: tuple[str, ...] = store.SEARCHED) -> Found:
    """``store.search`` over indexed invoices. A query without three letters in a row reads all parts. ``columns`` may be fewer than those indexed. The driver sees no more than ``RUNS`` numbers of folders, never parts or rows."""
    rows, known = spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/parts")
    grams = query_trigrams(query)
    every = known.count()
    if not grams:
        return Found(store.search(rows, query, columns).drop("run", "part"), every, every)
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
    buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
    index = spark.read.parquet(f"{folder}/grams").filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    held = index.groupBy("run", "part").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).drop("n")
    runs = {r["run"]: r["n"] for r in held.groupBy("run").agg(F.count("*").alias("n")).collect()}
    parts = sum(runs.values())
    own = rows.filter(F.col("run").isin(sorted(runs)) if runs else F.lit(False))
    if parts > len(runs) and parts < every:
        own = own.join(held.select("part"), "part", "left_semi")
    return Found(store.search(own, query, columns).drop("run", "part"), parts, every)


# ---- pages

@dataclass(frozen=True)
class By:
    """A sort column. Nulls come first if ascending, last if descending."""

    name: str
    descending: bool = False

    @property
    def column(self) -> Column:
        return F.col(self.name).desc() if self.descending else F.col(self.name).asc()


def _cuts(rows: DataFrame, by: By, key: str) -> list:
    """Values that cut the column into ranges of about equal size, in sort order: of a bounded sample by a hash of the key."""
    sample = rows.filter(F.col(by.name).isNotNull()).select(F.xxhash64(key).alias("h"), by.name).orderBy("h", by.name).limit(DRAWN).collect()
    values = sorted((r[by.name] for r in sample), reverse=by.descending)
    cuts = [values[len(values) * i // RANGES] for i in range(1, RANGES)] if values else []
    return [v for i, v in enumerate(cuts) if not i or v != cuts[i - 1]]


def _range(by: By, cuts: list, kind) -> Column:
    """The range of a row: each cut value has one of its own, so that a value with very many rows stands alone."""
    x = F.col(by.name)
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(v).cast(kind) for v in cuts])
    before = F.size(F.filter(bounds, lambda b: b > x if by.descending else b < x))
    at = F.when(F.array_contains(bounds, x), 1).otherwise(0)
    return F.when(x.isNull(), 2 * len(cuts) + 1 if by.descending else -1).otherwise(2 * before + at)


def _pieces(rows: DataFrame, offset: int, size: int, order: tuple[By, ...], left: tuple[By, ...], most: int) -> list[DataFrame]:
    if left:
        cuts = _cuts(rows, left[0], order[-1].name)
        placed = rows.withColumn("_range", _range(left[0], cuts, rows.schema[left[0].name].dataType))
        counts = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect())
        if sum(n for _, n in counts) > most:
            if len(counts) == 1:  # one value: the next column decides
                return _pieces(rows, offset, size, order, left[1:], most)
            out, at = [], 0
            for r, n in counts:
                low, high = max(offset, at), min(offset + size, at + n)
                if low < high:
                    out += _pieces(placed.filter(F.col("_range") == r).drop("_range"), low - at, high - low, order, left, most)
                at += n
            return out
    return [rows.orderBy(*[b.column for b in order]).offset(offset).limit(size)]


def page_rows(rows: DataFrame, offset: int, size: int, order: tuple[By, ...], most: int = SORTED) -> DataFrame:
    """``size`` rows from ``offset`` on in the given order, whose last column must tell rows apart. The range that holds them is found by counting, again and again, until no more than ``most`` rows are left to sort; a range of
    one value goes on with the next column, and a page across two ranges takes its part of each. What comes to the driver is a sample of ``DRAWN`` values and a count for each range."""
    found = _pieces(rows, offset, size, order, order, most)
    return reduce(DataFrame.unionByName, found).orderBy(*[b.column for b in order]) if found else rows.limit(0)


def next_page(rows: DataFrame, last: dict, size: int, order: tuple[By, ...]) -> DataFrame:
    """The ``size`` rows after the row with the values ``last``: no row before it is sorted or counted."""
    after, same = F.lit(False), F.lit(True)
    for by in order:
        x, v = F.col(by.name), F.lit(last[by.name]).cast(rows.schema[by.name].dataType)
        further = (x < v) if by.descending else (x > v)
        if last[by.name] is None:
            further = F.lit(False) if by.descending else x.isNotNull()
        elif by.descending:
            further = further | x.isNull()
        after = after | (same & F.coalesce(further, F.lit(False)))
        same = same & x.eqNullSafe(v)
    return rows.filter(after).orderBy(*[b.column for b in order]).limit(size)
