"""Queries on documents as records: text functions, JSON and XML, storage, search, jobs, geometry, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S
from ledgerlark.operators import geometry, store, tables
from ledgerlark.plans import derived
from ledgerlark.plans.derived import SQL_LINES, SQL_PRINTED, table
from ledgerlark.sources import documents as sources
from ledgerlark.streaming import jobs as J

P = SQL_PRINTED.format


# ---- text functions

def fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.fold_accents("text")).alias("folded"))


def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.compact("text")).alias("compact"))


def readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.regexp_replace("text", "\n", "\r\n \t\r\n\r\n  "), F.lit("\f page  two \n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.readable_pages(text)).alias("readable"))


READABLE_SQL = r"""WITH l AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10) || chr(10), 'g'), ' ') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') || chr(10) || chr(10) || '────────' || chr(10) || chr(10) || 'page two') AS readable FROM l"""


def markdown_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("## **Title**\n![logo](a.png)[link text](http://x) \\| "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.markdown_to_text(text)).alias("plain"))


MARKDOWN_SQL = r"""SELECT doc_id, md5(regexp_replace('Title' || chr(10) || 'link text | ' || regexp_replace(regexp_replace(text, '(^|\n)#{1,6}[ \t]+', '\1', 'g'), '[*_]+', '', 'g'), '^\s+|\s+$', '', 'g')) AS plain FROM documents"""


def usable_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(S.usable_text("text")).select("doc_id")


USABLE_SQL = r"""SELECT doc_id FROM (SELECT doc_id, trim(text, ' ') AS s FROM documents) WHERE length(s) >= 40 AND len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) >= 10
AND (length(s) - length(replace(s, chr(65533), ''))) / length(s) <= 0.01"""


def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.base64(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.regexp_replace(coded, r"[\r\n]", "")).alias("coded"), F.md5(F.unbase64(coded)).alias("back"), F.try_to_binary(F.concat(F.lit("*"), coded), F.lit("base64")).isNull().alias("bad_is_null")
    )


BASE64_SQL = "SELECT doc_id, md5(to_base64(encode(text))) AS coded, md5(text) AS back, true AS bad_is_null FROM documents"


def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".xml", ".JSON", ".pdf", ".jpeg", ".csv", ".bin", "")]), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    media = F.when(F.pmod("doc_id", F.lit(11)) == 0, "text/plain").when(F.pmod("doc_id", F.lit(13)) == 0, "application/xml")
    path = F.concat(F.col("source"), F.lit("/f"), F.col("doc_id"), suffix)
    return table(spark, sf_dir, "documents").select("doc_id", S.reader(path, media, F.pmod("doc_id", F.lit(2)) == 0).alias("reader"))


DISPATCH_SQL = """WITH f AS (SELECT doc_id, doc_id % 7 AS s, CASE WHEN doc_id % 11 = 0 THEN 'text/plain' WHEN doc_id % 13 = 0 THEN 'application/xml' ELSE '' END AS m FROM documents)
SELECT doc_id, CASE WHEN s = 0 OR m = 'application/xml' THEN 'xml' WHEN s = 1 THEN 'json' WHEN s = 2 THEN 'pdf' WHEN s = 3 THEN 'image' WHEN s = 4 OR m = 'text/plain' THEN 'text'
  WHEN doc_id % 2 = 0 THEN 'image' ELSE 'unknown' END AS reader FROM f"""


# ---- documents in JSON and XML

def _json_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id, document_json: plain documents for even keys, in the envelope of the exchange format for odd ones, where one line stands alone."""
    items = derived.lines(spark, sf_dir).groupBy("invoice_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l_linenumber", "l_partkey", "l_quantity"))), lambda x: F.struct(
        x["l_linenumber"].cast("string").alias("STT"), F.concat(F.lit("Part "), x["l_partkey"]).alias("THHDVu"), x["l_quantity"].cast("int").cast("string").alias("SLuong"))).alias("items"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("invoice_id")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    general = F.struct(F.col("o_orderkey").cast("string").alias("SHDon"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("NLap"), F.lit("VND").alias("DVTTe"))
    buyer, totals = F.struct(F.col("c_name").alias("Ten")), F.struct(derived.printed(F.col("o_totalprice").cast("decimal(19,2)")).alias("TgTTTBSo"))
    extra = F.struct(F.struct(F.lit("Priority").alias("TTruong"), F.lit("string").alias("KDLieu"), F.col("o_orderpriority").alias("DLieu")).alias("TTin"))
    plain = F.to_json(F.struct(general.alias("TTChung"), F.struct(buyer.alias("NMua"), F.col("items").alias("DSHHDVu"), totals.alias("TToan")).alias("NDHDon"), F.lit("M1").alias("MCCQT")))
    many = F.to_json(F.struct(F.struct(F.struct(general.alias("TTChung"), F.struct(buyer.alias("NMua"), F.struct(F.col("items").alias("HHDVu")).alias("DSHHDVu"), totals.alias("TToan"), extra.alias("TTKhac")).alias("NDHDon")).alias("DLHDon")).alias("HDon")))
    single = F.to_json(F.struct(F.struct(F.struct(general.alias("TTChung"), F.struct(buyer.alias("NMua"), F.struct(F.col("items")[0].alias("HHDVu")).alias("DSHHDVu"), totals.alias("TToan"), extra.alias("TTKhac")).alias("NDHDon")).alias("DLHDon")).alias("HDon")))
    made = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, plain).when(F.size("items") == 1, single).otherwise(many)
    return orders.select("invoice_id", made.alias("document_json"), "o_orderpriority", "c_name", "o_orderdate")


def core_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _json_orders(spark, sf_dir).select("invoice_id", sources.document_of_json(F.col("document_json")).alias("document"))
    return store.core_fields(docs, typed=True).select("invoice_id", "invoice_number", "issue_date", "currency", "buyer_name", "seller_name", "subtotal", "grand_total", "tax_authority_code")


CORE_SQL = """SELECT o_orderkey AS invoice_id, CAST(o_orderkey AS VARCHAR) AS invoice_number, CAST(o_orderdate AS DATE) AS issue_date, 'VND' AS currency, c_name AS buyer_name, '' AS seller_name,
CAST(NULL AS DECIMAL(19,4)) AS subtotal, CAST(CAST(o_totalprice AS DECIMAL(19,2)) AS DECIMAL(19,4)) AS grand_total, CASE o_orderkey % 2 WHEN 0 THEN 'M1' ELSE '' END AS tax_authority_code
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""


def json_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _json_orders(spark, sf_dir).select("invoice_id", sources.document_of_json(F.col("document_json")).alias("d"))
    c = F.col("d.NDHDon")
    return d.select("invoice_id", F.size(c["DSHHDVu"]).cast("long").alias("n_items"), F.get(c["DSHHDVu"], F.lit(0))["THHDVu"].alias("first"), F.size(c["TTKhac"]).cast("long").alias("n_extra"), F.coalesce(F.get(c["TTKhac"], F.lit(0))["DLieu"], F.lit("")).alias("extra"))


NORMALIZE_SQL = f"""WITH {SQL_LINES} SELECT l.invoice_id, count(*) AS n_items, 'Part ' || CAST(min(l_partkey) FILTER (pos = 1) AS VARCHAR) AS "first", CAST(l.invoice_id % 2 AS BIGINT) AS n_extra,
CASE l.invoice_id % 2 WHEN 1 THEN any_value(o_orderpriority) ELSE '' END AS extra FROM lines l JOIN orders ON l.invoice_id = o_orderkey GROUP BY l.invoice_id"""


def xml_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("<x:HHDVu><STT>"), F.col("l_linenumber"), F.lit("</STT><THHDVu> Part &amp; "), F.col("l_partkey"), F.lit(" </THHDVu></x:HHDVu>"))
    body = derived.lines(spark, sf_dir).groupBy("invoice_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("x")))), lambda x: x["x"]), "").alias("items"))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><HDon xmlns:x="urn:x"><DLHDon Id="d"><TTChung><SHDon a="1">'), F.col("invoice_id"), F.lit("</SHDon></TTChung><NDHDon><DSHHDVu>"), F.col("items"), F.lit("</DSHHDVu></NDHDon></DLHDon><MCCQT/></HDon>"))
    d = body.select("invoice_id", sources.xml_to_json(xml.cast("binary")).alias("x")).select("invoice_id", "x.error", sources.document_of_json(F.col("x.json")).alias("d"))
    names = F.array_join(F.transform("d.NDHDon.DSHHDVu", lambda x: x["THHDVu"]), ",")
    return d.select("invoice_id", F.col("d.TTChung.SHDon").alias("number"), F.size("d.NDHDon.DSHHDVu").cast("long").alias("n_items"), names.alias("names"), F.col("error").isNull().alias("valid"))


XML_SQL = f"""WITH {SQL_LINES} SELECT invoice_id, CAST(invoice_id AS VARCHAR) AS number, count(*) AS n_items, string_agg('Part & ' || l_partkey, ',' ORDER BY pos) AS names, true AS valid FROM lines GROUP BY invoice_id"""


def shred_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _json_orders(spark, sf_dir).select("invoice_id", sources.document_of_json(F.col("document_json")).alias("document"))
    return store.shredded_items(docs).select("invoice_id", F.col("line_number").cast("long").alias("line_number"), "description", "quantity", "amount")


SHRED_SQL = "SELECT l_orderkey AS invoice_id, CAST(l_linenumber AS BIGINT) AS line_number, 'Part ' || l_partkey AS description, CAST(CAST(l_quantity AS INTEGER) AS DECIMAL(19,4)) AS quantity, CAST(NULL AS DECIMAL(19,4)) AS amount FROM lineitem"


def shred_extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.get_json_object("props", "$.k")
    entry = lambda name, value: F.concat(F.lit(f'{{"TTruong":"{name}","KDLieu":"string","DLieu":"'), value, F.lit('"}'))
    made = F.concat(F.lit('{"TTKhac":['), entry("type", F.col("event_type")), F.lit('],"NDHDon":{"DSHHDVu":[{},{"TTKhac":[7,'), entry("k", F.coalesce(n, F.lit(""))), F.lit("]}]}}"))
    return store.shredded_extras(derived.spread(table(spark, sf_dir, "events")).select(F.col("event_id").alias("invoice_id"), made.alias("document_json")))


EXTRAS_SQL = """SELECT event_id AS invoice_id, 'HDon' AS group_path, 'type' AS field_name, 'string' AS data_type, event_type AS field_value FROM events
UNION ALL SELECT event_id, 'NDHDon.DSHHDVu[1]', 'k', 'string', coalesce(json_extract_string(props, '$.k'), '') FROM events"""


# ---- search and pages

def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_orderkey").alias("invoice_id"), F.concat(F.lit("HD_"), F.col("o_orderkey")).alias("invoice_number"), F.col("c_name").alias("buyer_name"), F.col("c_mktsegment").alias("seller_name"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").cast("decimal(19,2)").alias("grand_total"), F.when(F.pmod("o_orderkey", F.lit(5)) > 0, F.col("o_orderstatus")).alias("status"),
    )


SQL_INVOICES = """invoices AS (SELECT o_orderkey AS invoice_id, 'HD_' || o_orderkey AS invoice_number, c_name AS buyer_name, c_mktsegment AS seller_name, o_orderdate AS created_at,
CAST(o_totalprice AS DECIMAL(19,2)) AS grand_total, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS status FROM orders JOIN customer ON o_custkey = c_custkey)"""
COLUMNS = ("invoice_number", "buyer_name", "seller_name")
FOUND = """WHERE translate(invoice_number, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%d_1%' OR translate(buyer_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%d_1%'
OR translate(seller_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%d_1%'"""


def search_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.search(_invoices(spark, sf_dir), "D_1", COLUMNS).select("invoice_id", "invoice_number", "buyer_name")


def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.search(_invoices(spark, sf_dir), "D_1", COLUMNS).agg(F.count("*").alias("total"))


def page_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(_invoices(spark, sf_dir), 3, "25").select("invoice_id", "invoice_number", "created_at")


def client_sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.client_sort(_invoices(spark, sf_dir), "grand_total", descending=True).offset(20).limit(10).select("invoice_id", "grand_total")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _invoices(spark, sf_dir).filter(F.col("invoice_id") == 42)


def optional_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their text: the column isn't read."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


# ---- geometry

def cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.col("value").alias("v"))
    return geometry.clusters(values).select("g", F.col("cluster").cast("long").alias("cluster"), "n", F.round("middle", 6).alias("middle"))


CLUSTER_SQL = """WITH o AS (SELECT user_id AS g, value AS v, lag(value) OVER (PARTITION BY user_id ORDER BY value) AS p FROM events),
c AS (SELECT g, v, sum(CASE WHEN v - p > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY v RANGE UNBOUNDED PRECEDING) AS cluster FROM o)
SELECT g, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(median(v), 6) AS middle FROM c GROUP BY g, cluster"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_timestamp("ts").cast("double")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), at.alias("lo"), (at + F.pmod("event_id", F.lit(97)) * 400).cast("double").alias("hi"))


def interval_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.coverage(_spans(spark, sf_dir)).select("g", F.round("covered", 3).alias("covered"))


COVERAGE_SQL = """WITH s AS (SELECT user_id AS g, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS lo, epoch(date_trunc('second', ts)) + (event_id % 97) * 400 AS hi FROM events),
m AS (SELECT g, lo, hi, max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT g, CAST(round(sum(greatest(0, hi - greatest(lo, coalesce(reach, lo)))), 3) AS DOUBLE) AS covered FROM m GROUP BY g"""


def rule_groups_self_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    return geometry.largest_neighbourhood(parts, 25.0, 6)


RANGE_SQL = """WITH n AS (SELECT a.p_brand AS g, a.p_partkey AS id, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND abs(a.p_retailprice - b.p_retailprice) < 25 GROUP BY 1, 2)
SELECT g, id AS anchor, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, id) AS k FROM n) WHERE k = 1 AND n >= 6"""


def boundary_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    anchors = e.filter("event_type = 'signup'").select(F.pmod("user_id", F.lit(40)).alias("g"), (F.floor(F.col("value") / 40) * 40).cast("double").alias("v")).distinct()
    rules = e.filter("event_type != 'signup'").select(F.pmod("user_id", F.lit(40)).alias("g"), F.col("value").alias("y"), (F.pmod("event_id", F.lit(10)) / 10.0).cast("double").alias("covered"))
    return geometry.boundaries(anchors, rules)


BOUNDARY_SQL = """WITH a AS (SELECT DISTINCT user_id % 40 AS g, CAST(floor(value / 40) * 40 AS DOUBLE) AS v FROM events WHERE event_type = 'signup'),
p AS (SELECT * FROM (SELECT g, v AS lo, lead(v) OVER (PARTITION BY g ORDER BY v) AS hi FROM a) WHERE hi IS NOT NULL),
m AS (SELECT p.g, lo, hi, value AS y, row_number() OVER (PARTITION BY p.g, lo, hi ORDER BY CASE WHEN value IS NULL THEN 1 ELSE 0 END, (event_id % 10) / 10.0 DESC, abs(value - (lo + hi) / 2), value) AS k
 FROM p LEFT JOIN events e ON e.user_id % 40 = p.g AND event_type <> 'signup' AND value > lo + 4 AND value < hi - 4 AND (event_id % 10) / 10.0 > 0.3)
SELECT g, lo, hi, y FROM (SELECT *, bool_and(y IS NOT NULL) OVER (PARTITION BY g) AS whole FROM m WHERE k = 1) WHERE whole"""


def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(50)).alias("g"), F.col("event_id").alias("id"), F.col("value").alias("v"))
    cells = spark.range(50).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")).select("g", F.col("k").cast("long").alias("k"), (F.col("k") * 9.0).alias("lo"), (F.col("k") * 9.0 + 10.0).alias("hi"))
    return geometry.containing(points, cells)


POINT_SQL = """SELECT user_id % 50 AS g, event_id AS id, min(k) AS k FROM events JOIN (SELECT range AS k FROM range(20)) ON value BETWEEN k * 9.0 AND k * 9.0 + 10.0 GROUP BY 1, 2"""


def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    xs = c.select(F.col("c_nationkey").cast("long").alias("g"), F.floor(F.col("c_acctbal") / 1500).cast("double").alias("v")).distinct()
    ys = table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(25)).alias("g"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("v")).distinct()
    return geometry.grid(xs, ys).select("g", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "x0", "x1", "y0", "y1")


GRID_SQL = """WITH x AS (SELECT *, lead(v) OVER w AS v1, row_number() OVER w - 1 AS c FROM (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS g, CAST(floor(c_acctbal / 1500) AS DOUBLE) AS v FROM customer) WINDOW w AS (PARTITION BY g ORDER BY v)),
y AS (SELECT *, lead(v) OVER w AS v1, row_number() OVER w - 1 AS r FROM (SELECT DISTINCT o_custkey % 25 AS g, CAST(floor(o_totalprice / 50000) AS DOUBLE) AS v FROM orders) WINDOW w AS (PARTITION BY g ORDER BY v))
SELECT x.g, r, c, x.v AS x0, x.v1 AS x1, y.v AS y0, y.v1 AS y1 FROM x JOIN y ON x.g = y.g WHERE x.v1 IS NOT NULL AND y.v1 IS NOT NULL"""


def warnings_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's return flags in line order, every flag once where it first comes; and the same built by adding what isn't there."""
    per = derived.lines(spark, sf_dir).groupBy("invoice_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("all"))
    added = F.aggregate("all", F.array().cast("array<string>"), tables.appended_once)
    return per.select("invoice_id", F.array_join(F.array_distinct("all"), ",").alias("flags"), F.array_join(added, ",").alias("added"))


DISTINCT_SQL = f"""WITH {SQL_LINES}, f AS (SELECT invoice_id, l_returnflag, min(pos) AS p FROM lines GROUP BY 1, 2)
SELECT invoice_id, string_agg(l_returnflag, ',' ORDER BY p) AS flags, string_agg(l_returnflag, ',' ORDER BY p) AS added FROM f GROUP BY 1"""


# ---- jobs

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a job log: a user's events are dealt over seven jobs."""
    kind = F.create_map(*[F.lit(x) for x in ("signup", "queued", "view", "running", "click", "heartbeat", "purchase", "completed", "error", "failed")])
    at = F.unix_timestamp("ts").cast("double")
    job = F.col("user_id") * 1000 + F.pmod("event_id", F.lit(7))
    return table(spark, sf_dir, "events").select(job.alias("job_id"), at.alias("at"), F.element_at(kind, F.col("event_type")).alias("kind"), F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("m"), F.col("event_id"))).alias("message"))


def _now(spark: SparkSession, sf_dir: str) -> float:
    return _events(spark, sf_dir).agg(F.max("at")).first()[0] - 86400.0


SQL_JOBS = """log AS (SELECT user_id * 1000 + event_id % 7 AS job_id, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS tick,
 CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS kind,
 CASE WHEN event_id % 3 = 0 THEN 'm' || event_id END AS message FROM events),
clock AS (SELECT max(tick) - 86400 AS now FROM log),
ended AS (SELECT job_id, kind, tick FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY tick, kind) AS k FROM log WHERE kind IN ('completed', 'failed')) WHERE k = 1),
going AS (SELECT job_id, kind, tick FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY tick DESC, kind DESC) AS k FROM log WHERE kind IN ('queued', 'running')) WHERE k = 1),
jobs AS (SELECT job_id, kind AS status, tick AS changed, tick + 3600 AS expires FROM ended UNION ALL SELECT job_id, kind, tick, tick + 7200 FROM going WHERE job_id NOT IN (SELECT job_id FROM ended)),
beats AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN message IS NULL THEN 1 ELSE 0 END, tick DESC, message DESC) AS k FROM log WHERE kind = 'heartbeat'),
progress AS (SELECT job_id, max(tick) AS heartbeat, max(message) FILTER (k = 1) AS message FROM beats GROUP BY job_id)"""


def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.jobs(_events(spark, sf_dir))


def job_status_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return J.status(J.jobs(e), J.progress(e), F.lit(_now(spark, sf_dir)))


def job_orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return J.orphans(J.progress(e), J.jobs(e)).select("job_id", "heartbeat")


def job_stale_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return J.stale(J.jobs(e), J.progress(e), F.lit(_now(spark, sf_dir))).select("job_id", "status")


def job_active_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.active(J.jobs(_events(spark, sf_dir)))


# ---- the store

def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a store: every third was updated (customer and price change, file name doesn't), every tenth deleted."""
    first = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id"), F.lit(1).alias("version"), F.lit(False).alias("deleted"), F.concat(F.lit("f"), F.col("o_orderkey")).alias("source_filename"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    changes = first.filter("invoice_id % 3 = 0").select("invoice_id", F.lit("ignored").alias("source_filename"), (F.col("customer") + 1).alias("customer"))
    log = store.updated(first, changes, kept=("source_filename",))
    return store.deleted(log, first.filter("invoice_id % 10 = 0").select("invoice_id"))


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(_log(spark, sf_dir)).select("invoice_id", F.col("version").cast("long").alias("version"), "source_filename", "customer", "priority")


LATEST_SQL = """SELECT o_orderkey AS invoice_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, 'f' || o_orderkey AS source_filename,
 o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS customer, o_orderpriority AS priority FROM orders WHERE o_orderkey % 10 <> 0"""


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived.lines(spark, sf_dir).select("invoice_id", F.col("pos").cast("long").alias("pos"), "l_partkey")
    return store.orphans_removed(lines, store.latest(_log(spark, sf_dir)))


def nested_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the buyer's name replaced, the second line's name changed, the first line removed and one appended."""
    d = _json_orders(spark, sf_dir).select("invoice_id", sources.document_of_json(F.col("document_json")).alias("document"))
    rows = F.col("document.NDHDon.DSHHDVu")
    new = F.get(rows, F.lit(0)).withField("THHDVu", F.lit("new"))
    changed = store.with_row(store.without_row(store.with_item_value(rows, 1, "THHDVu", F.lit("changed")), 0), new)
    d = d.select("invoice_id", store.with_value(store.with_value(F.col("document"), "NDHDon.NMua.Ten", F.lit("Buyer")), "NDHDon.DSHHDVu", changed).alias("d"))
    names = F.array_join(F.transform("d.NDHDon.DSHHDVu", lambda x: F.concat(x["STT"], F.lit(":"), x["THHDVu"])), ",")
    return d.select("invoice_id", F.col("d.NDHDon.NMua.Ten").alias("buyer"), names.alias("lines"))


NESTED_SQL = f"""WITH {SQL_LINES} SELECT invoice_id, 'Buyer' AS buyer, coalesce(string_agg(l_linenumber || ':' || CASE pos WHEN 2 THEN 'changed' ELSE 'Part ' || l_partkey END, ',' ORDER BY pos) FILTER (pos > 1) || ',', '')
 || count(*) || ':new' AS lines FROM lines GROUP BY invoice_id"""

QUERIES = {f.__name__: f for f in (
    fold_accents, compact_text, readable_text, markdown_to_text, usable_text_filter, base64_roundtrip, format_dispatch, core_fields, json_normalize, xml_normalize, shred_items, shred_extra_fields,
    search_invoices, search_count, page_invoices, client_sort_page, point_lookup, optional_projection, cluster_1d, interval_union_coverage, rule_groups_self_range_join, boundary_argmax, point_in_interval,
    cell_grid, warnings_distinct, job_latest_state, job_status_left_join, job_orphans_anti, job_stale_anti, job_active_count, latest_version, cascade_delete, nested_update,
)}
ORACLES = {
    "fold_accents": "SELECT doc_id, md5(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D'))) AS folded FROM documents",
    "compact_text": r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS compact FROM documents",
    "readable_text": READABLE_SQL, "markdown_to_text": MARKDOWN_SQL, "usable_text_filter": USABLE_SQL, "base64_roundtrip": BASE64_SQL, "format_dispatch": DISPATCH_SQL, "core_fields": CORE_SQL,
    "json_normalize": NORMALIZE_SQL, "xml_normalize": XML_SQL, "shred_items": SHRED_SQL, "shred_extra_fields": EXTRAS_SQL,
    "search_invoices": f"WITH {SQL_INVOICES} SELECT invoice_id, invoice_number, buyer_name FROM invoices {FOUND}",
    "search_count": f"WITH {SQL_INVOICES} SELECT count(*) AS total FROM invoices {FOUND}",
    "page_invoices": f"WITH {SQL_INVOICES} SELECT invoice_id, invoice_number, created_at FROM invoices ORDER BY created_at DESC, invoice_id LIMIT 25 OFFSET 50",
    "client_sort_page": f"WITH {SQL_INVOICES} SELECT invoice_id, grand_total FROM invoices ORDER BY CAST(grand_total AS VARCHAR) DESC, invoice_id LIMIT 10 OFFSET 20",
    "point_lookup": f"WITH {SQL_INVOICES} SELECT * FROM invoices WHERE invoice_id = 42",
    "optional_projection": "SELECT doc_id, lang, source, n_chars FROM documents",
    "cluster_1d": CLUSTER_SQL, "interval_union_coverage": COVERAGE_SQL, "rule_groups_self_range_join": RANGE_SQL, "boundary_argmax": BOUNDARY_SQL, "point_in_interval": POINT_SQL, "cell_grid": GRID_SQL,
    "warnings_distinct": DISTINCT_SQL,
    "job_latest_state": f"WITH {SQL_JOBS} SELECT * FROM jobs",
    "job_status_left_join": f"WITH {SQL_JOBS} SELECT j.*, heartbeat, message FROM jobs j LEFT JOIN progress USING (job_id), clock WHERE expires >= now",
    "job_orphans_anti": f"WITH {SQL_JOBS} SELECT job_id, heartbeat FROM progress WHERE job_id NOT IN (SELECT job_id FROM jobs)",
    "job_stale_anti": f"WITH {SQL_JOBS} SELECT job_id, status FROM jobs, clock WHERE status IN ('queued', 'running') AND job_id NOT IN (SELECT job_id FROM progress, clock WHERE heartbeat > now - 120)",
    "job_active_count": f"WITH {SQL_JOBS} SELECT count(*) AS n FROM jobs WHERE status IN ('queued', 'running')",
    "latest_version": LATEST_SQL,
    "cascade_delete": f"WITH {SQL_LINES} SELECT invoice_id, pos, l_partkey FROM lines WHERE invoice_id % 10 <> 0 AND invoice_id IN (SELECT o_orderkey FROM orders)",
    "nested_update": NESTED_SQL,
}
