"""Queries on large groups and on pages as boxes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlark.operators import geometry, layout
from ledgerlark.plans.derived import pieces, table

#: Rows from which a group is cut in these queries, so that their one group is.
CUT = 400
#: Pages of a task.
PAGES = 2000


# ---- one group

def clusters_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by time in one group: bursts with less than 20 minutes between events."""
    values = table(spark, sf_dir, "events").select(F.lit("all").alias("g"), F.unix_timestamp("ts").cast("double").alias("v"))
    return geometry.clusters(values, 1200.0, CUT).select("g", F.col("cluster").cast("long").alias("cluster"), "n", "middle")


ONE_CLUSTER_SQL = """WITH e AS (SELECT CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS v FROM events), o AS (SELECT v, lag(v) OVER (ORDER BY v) AS p FROM e),
c AS (SELECT v, sum(CASE WHEN v - p > 1200 THEN 1 ELSE 0 END) OVER (ORDER BY v RANGE UNBOUNDED PRECEDING) AS cluster FROM o)
SELECT 'all' AS g, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, median(v) AS middle FROM c GROUP BY cluster"""


def coverage_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of all time some event's interval covers, for all events together and by type."""
    at = F.unix_timestamp("ts").cast("double")
    spans = table(spark, sf_dir, "events").select(F.explode(F.array(F.lit("all"), F.col("event_type"))).alias("g"), at.alias("lo"), (at + F.pmod("event_id", F.lit(13)) * 60).cast("double").alias("hi"))
    return geometry.coverage(spans, CUT)


ONE_COVERAGE_SQL = """WITH e AS (SELECT *, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS lo FROM events),
s AS (SELECT unnest(['all', event_type]) AS g, lo, lo + (event_id % 13) * 60 AS hi FROM e),
m AS (SELECT g, lo, hi, max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT g, CAST(sum(greatest(0, hi - greatest(lo, coalesce(reach, lo)))) AS DOUBLE) AS covered FROM m GROUP BY g"""


def interval_any_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order's price the first part whose price interval holds it: intervals of lengths 1 to 10^6, all in one group."""
    points = table(spark, sf_dir, "orders").select(F.lit(1).alias("g"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    length = F.pow(F.lit(10.0), F.pmod("p_partkey", F.lit(7)).cast("double"))
    low = F.when(F.pmod("p_partkey", F.lit(97)) == 0, 0.0).otherwise(F.col("p_retailprice") * F.pmod("p_partkey", F.lit(211)))
    spans = table(spark, sf_dir, "part").select(F.lit(1).alias("g"), (10_000_000 - F.col("p_partkey")).alias("k"), low.alias("lo"), (low + length).alias("hi"))
    return geometry.containing(points, spans, CUT)


ANY_LENGTH_SQL = """WITH s AS (SELECT 10000000 - p_partkey AS k, CASE WHEN p_partkey % 97 = 0 THEN 0.0::DOUBLE ELSE p_retailprice * (p_partkey % 211) END AS lo, pow(10.0::DOUBLE, p_partkey % 7) AS n FROM part)
SELECT CAST(1 AS INTEGER) AS g, o_orderkey AS id, min(k) AS k FROM orders JOIN s ON o_totalprice BETWEEN lo AND lo + n GROUP BY o_orderkey"""


# ---- pages as boxes

def _strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes of a pen: on page user_id % 20 a bar for each event, every third downwards, 1 to 5 pixels thick, 40 to 440 long, with a gap of 0 to 14 in the middle."""
    e = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(20)).alias("g"), "event_id")
    nth = F.row_number().over(W.partitionBy("g").orderBy("event_id"))
    n = F.col("event_id")
    return e.select("g", (F.pmod(n, F.lit(3)) > 0).alias("across"), (12 * nth).cast("long").alias("at"), (1 + F.pmod(n, F.lit(5))).alias("thick"), (40 + F.pmod(n * 37, F.lit(401))).alias("long"), F.pmod(n, F.lit(15)).alias("gap"), F.pmod(n * 7, F.lit(100)).alias("lo"))


def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that a page's pixels show, in points."""
    s = _strokes(spark, sf_dir)
    half = F.floor(F.col("long") / 2)
    middle = F.col("lo") + half
    sides = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + F.col("gap")).alias("lo"), (F.col("lo") + F.col("long") + F.col("gap")).alias("hi")))
    runs = s.select("g", "across", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("thick") - 1)).alias("line"), sides.alias("sides")).select("g", "across", "line", F.inline("sides"))
    pages = s.groupBy("g").agg(F.lit(3000).alias("pixels_x"), F.lit(3000).alias("pixels_y")).withColumns({"width": F.lit(600.0), "height": F.lit(900.0)})
    return layout.grid_lines(runs, pages).drop("id").select("g", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


STROKES_SQL = """e AS (SELECT user_id % 20 AS g, event_id AS n, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS nth FROM events),
s AS (SELECT g, n % 3 > 0 AS across, 12 * nth AS line, 1 + n % 5 AS thick, 40 + n * 37 % 401 AS size, n % 15 AS gap, n * 7 % 100 AS lo FROM e),
p AS (SELECT g, across, line, thick, lo, lo + size + gap AS hi FROM s WHERE gap < CASE WHEN across THEN 12 ELSE 8 END
 UNION ALL SELECT g, across, line, thick, lo, lo + size // 2 FROM s WHERE gap >= CASE WHEN across THEN 12 ELSE 8 END
 UNION ALL SELECT g, across, line, thick, lo + size // 2 + gap, lo + size + gap FROM s WHERE gap >= CASE WHEN across THEN 12 ELSE 8 END),
r AS (SELECT g, across, lo, hi, line + thick / 2.0::DOUBLE AS mid FROM p WHERE hi - lo >= 100 AND hi - lo > 5 * thick)"""
LINES_SQL = f"""WITH {STROKES_SQL} SELECT g, round(CASE WHEN across THEN lo ELSE mid END * 0.2, 6) AS x0, round(CASE WHEN across THEN mid ELSE lo END * 0.3, 6) AS y0, round(CASE WHEN across THEN hi ELSE mid END * 0.2, 6) AS x1,
 round(CASE WHEN across THEN mid ELSE hi END * 0.3, 6) AS y1 FROM r"""


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents set on pages of two columns below a title, a little askew, and read back from their boxes."""
    words = F.filter(F.split(F.translate("text", "\t\n\r\u000b\f ", "      "), " +"), lambda w: w != "")
    sheets = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - 1) / 203)).cast("int")), lambda p: F.struct(p.alias("page"), F.slice("words", p * 203 + 1, 203).alias("words")))
    own = table(spark, sf_dir, "documents").select("doc_id", words.alias("words")).filter(F.size("words") > 0).select("doc_id", F.explode(sheets).alias("s"))
    moved = own.select(F.concat_ws(":", "doc_id", "s.page").alias("g"), "s.page", "s.words")
    moved = moved.repartition(pieces(moved, PAGES), "g")  # as texts: the boxes made of them are wider and stay where they are, in tasks whose sorts fit into memory
    w = moved.select("g", F.posexplode("words").alias("k", "text"), "page").withColumn("i", F.col("page") * 203 + F.col("k"))
    k = F.col("k")
    body = k - 3
    column, row, place = F.floor(body / 100), F.floor(F.pmod(body, F.lit(100)) / 5), F.pmod(body, F.lit(5))
    title = k < 3
    x0 = F.when(title, 150.0 + k * 45).otherwise(20.0 + column * 300 + place * 50)
    y0 = F.when(title, 20.0).otherwise(60.0 + row * 13) + F.pmod("i", F.lit(3))
    boxes = w.select("g", F.col("i").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 10).alias("y1"), "text")
    return layout.reading_order(boxes).select("g", F.md5("text").alias("text"))


READING_SQL = r"""WITH w AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS i FROM (SELECT doc_id, [x FOR x IN string_split(translate(text, chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160), '      '), ' ') IF x <> ''] AS l FROM documents)),
b AS (SELECT doc_id || ':' || (i // 203) AS g, i % 203 AS k, text FROM w),
c AS (SELECT g, text, k, CASE WHEN k < 3 THEN 0 ELSE 1 + (k - 3) // 100 END AS part, CASE WHEN k < 3 THEN 0 ELSE (k - 3) % 100 // 5 END AS row FROM b),
l AS (SELECT g, part, row, string_agg(text, ' ' ORDER BY k) AS t FROM c GROUP BY 1, 2, 3), p AS (SELECT g, part, string_agg(t, chr(10) ORDER BY row) AS t FROM l GROUP BY 1, 2)
SELECT g, md5(string_agg(t, chr(10) || chr(10) ORDER BY part)) AS text FROM p GROUP BY g"""

QUERIES = {f.__name__: f for f in (clusters_one_group, coverage_one_group, interval_any_length, grid_lines, reading_order)}
ORACLES = {"clusters_one_group": ONE_CLUSTER_SQL, "coverage_one_group": ONE_COVERAGE_SQL, "interval_any_length": ANY_LENGTH_SQL, "grid_lines": LINES_SQL, "reading_order": READING_SQL}
