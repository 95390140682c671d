"""Invoices derived from the star-schema tables.

An invoice is an order with its customer; its lines are the order's lineitems in a total order; its seller is the supplier with the
least key among them. Declared totals are built from the lines with fixed deviations, so that every rule finds something.
Amounts are printed the way invoices print them: 1.234.567,50.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its files have fewer: for rows that are narrow but cost much to work on. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pieces(df: DataFrame, rows: int = 20_000) -> int:
    """In how many partitions ``df`` has no more than about ``rows`` rows each: for rows that are narrow but cost much to work on, or grow wide, which partitions by bytes don't know."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def printed(c: Column, digits: int = 2) -> Column:
    return F.translate(F.format_number(c, digits), ",.", ".,")


LINE_ORDER = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_shipdate l_returnflag l_linestatus".split()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id, pos (from 1) and a lineitem's columns; the only shuffle is by order. Its partitions grow in number with the lines, not in size: what is made of a line is some twenty times as wide as the line,
    and the sorts and groupings of it, which all keep this partitioning, would spill."""
    own = table(spark, sf_dir, "lineitem")
    parts = -(-own.count() // 150_000)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        own = own.repartition(parts, "l_orderkey")
    return own.withColumn("pos", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER))).withColumnRenamed("l_orderkey", "invoice_id")


MONEY = "decimal(19,2)"


def line_amount() -> Column:
    return F.col("l_extendedprice").cast(MONEY)


def line_tax() -> Column:
    return F.round(F.col("l_extendedprice").cast(MONEY) * F.col("l_tax").cast("decimal(4,2)"), 2).cast(MONEY)


def _item(lines_: DataFrame, *more: Column) -> DataFrame:
    key = F.col("invoice_id") + F.col("pos")
    price = (F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)") / 100).cast(MONEY)
    off = F.pmod(key, F.lit(5)) == 0
    discount = F.when(off, F.lit("5")).otherwise(F.lit("0"))
    return lines_.select(
        "invoice_id", "pos",
        F.when(F.pmod(key, F.lit(17)) == 0, "4").otherwise("1").alias("TChat"),
        F.col("l_linenumber").cast("string").alias("STT"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("MHHDVu"),
        F.concat(F.lit("Part "), F.col("l_partkey")).alias("THHDVu"),
        F.lit("Cái").alias("DVTinh"),
        printed(F.col("l_quantity").cast(MONEY)).alias("SLuong"),
        F.when(F.pmod(key, F.lit(23)) == 0, "?").otherwise(printed(price)).alias("DGia"),
        F.lit("").alias("TLCKhau"),
        F.when(off & (F.pmod(key, F.lit(2)) == 0), discount).otherwise("").alias("STCKhau"),
        printed(_net()).alias("ThTien"),
        F.concat(F.round(F.col("l_tax") * 100).cast("int"), F.lit("%")).alias("TSuat"),
        F.when(F.pmod(F.col("invoice_id"), F.lit(19)) == 0, "").otherwise(printed(line_tax())).alias("TThue"), *more,
    )


def _net() -> Column:
    return line_amount() - F.when(F.pmod(F.col("invoice_id") + F.col("pos"), F.lit(5)) == 0, F.lit(5).cast(MONEY)).otherwise(F.lit(0).cast(MONEY))


def _stated(amount: Column, tax: Column) -> list[Column]:
    every = lambda n, value: F.when(F.pmod(F.col("invoice_id"), F.lit(n)) == 0, F.lit(value)).otherwise(F.lit(0)).cast(MONEY)
    subtotal, tax = amount + every(7, 2) + every(11, 1), tax + every(13, 3)
    total = F.when(F.pmod(F.col("invoice_id"), F.lit(29)) == 0, "n/a").otherwise(printed(subtotal + tax + every(17, 5)))
    return [printed(subtotal).alias("TgTCThue"), printed(tax).alias("TgTThue"), total.alias("TgTTTBSo")]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines as printed: every fifth line's quantity times price is off by its discount, which only every other of them states."""
    return _item(lines(spark, sf_dir))


def stated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id, TgTCThue, TgTThue, TgTTTBSo as printed. Every 7th subtotal is 2 too high, every 11th 1 too high (which passes), every 13th tax is 3 too
    high, every 17th total 5 too high, every 29th total unreadable."""
    sums = lines(spark, sf_dir).groupBy("invoice_id").agg(F.sum(_net()).alias("amount"), F.sum(line_tax()).alias("tax"))
    return sums.select("invoice_id", *_stated(F.col("amount"), F.col("tax")))


def whole_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with their invoice's stated totals, from one numbering of the lines: one scan and one shuffle."""
    by_invoice = W.partitionBy("invoice_id")
    summed = lines(spark, sf_dir).withColumns({"_net": F.sum(_net()).over(by_invoice), "_tax": F.sum(line_tax()).over(by_invoice)})
    return _item(summed, *_stated(F.col("_net"), F.col("_tax")))


#: The same in SQL: views that the oracle queries start with.
SQL_LINES = """
lines AS (SELECT *, l_orderkey AS invoice_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
  l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS pos FROM lineitem),
typed AS (SELECT invoice_id, pos, l_linenumber AS stt, CASE WHEN (invoice_id + pos) % 17 = 0 THEN '4' ELSE '1' END AS kind,
  CAST(l_quantity AS DECIMAL(19,2)) AS quantity, CASE WHEN (invoice_id + pos) % 23 = 0 THEN NULL ELSE CAST((CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) / 100.0 AS DECIMAL(19,2)) END AS price,
  (invoice_id + pos) % 5 = 0 AS is_off, (invoice_id + pos) % 10 = 0 AS is_stated,
  CAST(l_extendedprice AS DECIMAL(19,2)) - CASE WHEN (invoice_id + pos) % 5 = 0 THEN CAST(5 AS DECIMAL(19,2)) ELSE CAST(0 AS DECIMAL(19,2)) END AS amount,
  CAST(round(CAST(l_extendedprice AS DECIMAL(19,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(19,2)) AS line_tax,
  CAST(round(l_tax * 100) AS INTEGER) AS rate FROM lines),
sums AS (SELECT invoice_id, sum(amount) AS amounts, sum(line_tax) AS taxes FROM typed GROUP BY invoice_id),
totals AS (SELECT invoice_id,
  amounts + CASE WHEN invoice_id % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN invoice_id % 11 = 0 THEN 1 ELSE 0 END AS subtotal,
  taxes + CASE WHEN invoice_id % 13 = 0 THEN 3 ELSE 0 END AS tax_total FROM sums),
stated AS (SELECT *, CASE WHEN invoice_id % 29 = 0 THEN NULL ELSE subtotal + tax_total + CASE WHEN invoice_id % 17 = 0 THEN 5 ELSE 0 END END AS total FROM totals)
"""
SQL_PRINTED = "translate(format('{{:,.2f}}', CAST({} AS DOUBLE)), ',.', '.,')"
