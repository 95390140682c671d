"""The operators over their whole tables, with production parameters, as the entry point registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import decontaminate, fingerprint, html_text, jaccard, language_model, licenses, mixing, quality, resample, sharding, toxicity, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "blocks")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_decontamination": op2_decontamination,
    "op3_jaccard": op3_jaccard,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_html": op6_html,
    "op7_licenses": op7_licenses,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_sharding": op10_sharding,
    "op11_trie": op11_trie,
    "op12_resampling": op12_resampling,
    "op13_language_model": op13_language_model,
}

MIXING_SQL = r"""
WITH sized AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS ord FROM documents),
own AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM own),
ratios AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, CAST(2 * source_size AS DOUBLE) / weight AS ratio, 1.5 * sum(source_size) OVER () AS total FROM weighed),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY ratio, source NULLS LAST) AS k FROM ratios),
water AS (SELECT min_by(level, k) AS level FROM levels WHERE level < ratio),
goals AS (SELECT source, source_size, CAST(CASE WHEN w.level IS NULL THEN cap ELSE least(cap, weight * w.level) END AS DOUBLE) AS target FROM levels, water w),
seats AS (SELECT source, row_number() OVER (ORDER BY target / (2 * s.range + 1) DESC, source NULLS LAST, s.range) AS place, n
  FROM goals, (SELECT CAST(round(sum(target) / 16) AS BIGINT) AS n FROM goals), range(100000) s WHERE s.range < n),
blocks AS (SELECT g.source, source_size, target, coalesce(b, 0) AS blocks FROM goals g
  LEFT JOIN (SELECT source, count(*) AS b FROM seats WHERE place <= n GROUP BY source) q ON g.source IS NOT DISTINCT FROM q.source),
runs AS (SELECT *, least(blocks * 16, 2 * source_size) // greatest(source_size, 1) AS whole, least(blocks * 16, 2 * source_size) % greatest(source_size, 1) AS rest FROM blocks),
cut AS (SELECT *, rest // 16 AS r, rest % 16 AS odd, source_size // 16 AS b, coalesce(sum((rest // 16) % 40) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 40 AS first FROM runs),
counts AS (SELECT source, r, b, pos, b // 40 + CASE WHEN pos < b % 40 THEN 1 ELSE 0 END AS n, r // 40 + CASE WHEN pos < r % 40 THEN 1 ELSE 0 END AS e, (pos + first) % 40 AS shard FROM cut, range(40) t(pos)),
picks AS (SELECT *, CAST('0x' || substr(md5('42:' || coalesce(source, 'null') || ':' || CAST(shard AS BIGINT)), 1, 15) AS BIGINT) % greatest(n, 1) AS beg FROM counts),
odds AS (SELECT c.*, CASE WHEN c.r < c.b THEN ((p.beg + p.e) % greatest(p.n, 1) * 40 + p.pos) * 16 ELSE c.b * 16 END AS odd_at FROM cut c JOIN picks p ON c.source IS NOT DISTINCT FROM p.source AND p.pos = c.r % 40),
placed AS (SELECT s.row, s.doc_id, s.size, r.*, sum(s.size) OVER (PARTITION BY s.source ORDER BY ord, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS stop
  FROM sized s JOIN odds r ON s.source IS NOT DISTINCT FROM r.source),
pieces AS (SELECT row, source, stop - size AS lo, stop, unnest(range(CAST((stop - size) // 16 AS BIGINT), CAST((stop - 1) // 16 + 1 AS BIGINT))) AS k FROM placed WHERE size > 0),
taken AS (SELECT row, sum(least(stop, 16 * k + 16) - greatest(lo, 16 * k)) AS n FROM pieces x JOIN picks p ON x.source IS NOT DISTINCT FROM p.source AND k % 40 = pos
  WHERE k < b AND ((k // 40 - beg) % n + n) % n < e GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(blocks AS BIGINT) AS blocks,
  CAST(whole * size + coalesce(n, 0) + greatest(0, least(stop, odd_at + odd) - greatest(stop - size, odd_at)) AS BIGINT) AS taken FROM placed LEFT JOIN taken USING (row)
"""

_TEMPLATES = ", ".join(f"('{t}', '{label}')" for t, label in licenses.TEMPLATES.items())
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACES = " || ".join(
    f"[i FOR i IN range(len(w)) IF w[i + 1:i + {len(p.split())}] = [{', '.join(repr(x) for x in p.split())}]]" for p in licenses.PHRASES
)
_BASE = " || ".join(f"CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' {p} ') THEN ['{label}'] ELSE [] END" for p, label in licenses.PHRASES.items())
LICENSES_SQL = f"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}') AS t FROM documents),
worded AS (SELECT doc_id, r, t, regexp_extract_all(t, '{_WORDS}') AS w FROM low),
based AS (SELECT doc_id, r, t, len(w) AS n_words, CASE WHEN t LIKE '%license%' OR t LIKE '%nc%' THEN {_PLACES} ELSE [] END AS places, {_BASE} AS base FROM worded),
filled AS (SELECT r, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{_WORDS}')] AS own FROM low WHERE regexp_matches(t, 'license|licensed|granted|compliance|redistribut|rights|mozilla')),
lines AS (SELECT r, list_distinct(regexp_extract_all(unnest([array_to_string(own[i:i + 2], chr(10)) FOR i IN range(1, len(own) + 1)]), '{_WORDS}')) AS b FROM filled),
templates AS (SELECT label, list_distinct(string_split(t, ' ')) AS words FROM (VALUES {_TEMPLATES}) AS v(t, label)),
met AS (SELECT r, label, len(list_intersect(words, b)) / len(words) AS share FROM lines, templates WHERE len(list_intersect(words, b)) >= {licenses.THRESHOLD} * len(words) - 1e-9),
per AS (SELECT r, list(DISTINCT label) AS found, max(share) AS share FROM met GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score FROM based LEFT JOIN per USING (r)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {shift}) & 31), 1)" for g in range(8) for shift in (15, 10, 5, 0)
)
WARC_SQL = f"""
WITH hashed AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
own AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_page FROM hashed)
SELECT page_id, coalesce(url, 'urn:page:' || page_id) AS uri, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first_page THEN NULL ELSE first_page END AS refers_to, true AS valid FROM own
"""

#: The CRC-32 of ``x`` as a number: the table's entries are eight shifts each.
_CRC_TABLE = "(SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) FROM range(256) t(i))"


def _crc_sql(x: str) -> str:
    octets = f"[CAST(('0x' || substr(hex(encode({x})), 2 * k + 1, 2)) AS BIGINT) FOR k IN range(strlen({x}))]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda a, b: xor(a >> 8, crc_table[1 + (xor(a, b) & 255)])), 4294967295)"


RESAMPLING_SQL = f"""
WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc_table),
words AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{_WORDS}') AS w FROM documents),
goal AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{_WORDS}')) AS x FROM benchmark),
own AS MATERIALIZED (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM words) GROUP BY r, x),
hashed AS MATERIALIZED (SELECT x, {_crc_sql("x")} % {resample.BUCKETS} AS b FROM (SELECT x FROM own UNION SELECT x FROM goal), crc),
s AS (SELECT b, sum(n) AS n FROM own JOIN hashed USING (x) GROUP BY b), t AS (SELECT b, count(*) AS n FROM goal JOIN hashed USING (x) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM s) + {resample.BUCKETS} AS DOUBLE)
  / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM t) + {resample.BUCKETS} AS DOUBLE)))) AS BIGINT) AS g FROM (SELECT DISTINCT b FROM hashed) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
sums AS (SELECT r, CAST(sum(n * g) AS BIGINT) AS total FROM own JOIN hashed USING (x) JOIN gain USING (b) GROUP BY r),
weighed AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END AS weight,
  CAST(('0x' || substr(sha256('{resample.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) AS h FROM words LEFT JOIN sums USING (r)),
scored AS (SELECT doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT *, n >= {resample.LEAST} AS able, row_number() OVER (PARTITION BY n >= {resample.LEAST} ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (n >= {resample.LEAST}) OVER () AS many FROM scored)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN able AND k <= {resample.PERCENT} * many // 100 THEN k END AS BIGINT) AS rank FROM placed
"""

TRIE_SQL = f"""
WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc_table),
numbered AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
digested AS (SELECT conv_id, turn, len(text) AS chars, substr(sha256(len(role) || ':' || role || text), 1, 32) AS dg FROM numbered),
own AS MATERIALIZED (SELECT conv_id AS c, chars, dg, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) AS pos FROM digested),
convs AS MATERIALIZED (SELECT c, c - c % {trie.FAMILY} AS base, {_crc_sql("CAST(c AS VARCHAR)")} % {trie.CYCLE} AS h FROM (SELECT DISTINCT c FROM own), crc),
lengths AS (SELECT c AS base, max(pos) AS n FROM own GROUP BY c),
rebuilt AS (SELECT v.c, o.pos AS d, o.chars, o.dg FROM convs v JOIN own o ON o.c = v.base AND o.pos <= v.h
  UNION ALL SELECT v.c, least(v.h, coalesce(l.n, 0)) + o.pos - v.h, o.chars, o.dg FROM convs v JOIN own o ON o.c = v.c AND o.pos > v.h LEFT JOIN lengths l ON l.base = v.base),
paths AS MATERIALIZED (SELECT c, d, chars, sha256(string_agg(dg, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM rebuilt UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS MATERIALIZED (SELECT k, d, min(c) AS c, count(*) AS n, any_value(chars) AS chars FROM paths GROUP BY k, d),
linked AS MATERIALIZED (SELECT n.*, p.k AS up FROM nodes n LEFT JOIN paths p ON p.c = n.c AND p.d = n.d - 1),
children AS (SELECT up AS k, count(*) AS n FROM linked WHERE up IS NOT NULL GROUP BY up),
subtree AS (SELECT p.k, sum((n.n - 1) * n.chars) AS saved, count(*) FILTER (n.k NOT IN (SELECT k FROM children)) AS leaves FROM nodes n JOIN paths p ON p.c = n.c AND p.d <= n.d GROUP BY p.k),
ends AS (SELECT p.k, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids FROM paths p JOIN (SELECT c, max(d) AS d FROM paths GROUP BY c) m ON p.c = m.c AND p.d = m.d GROUP BY p.k)
SELECT CAST(x.c AS BIGINT) AS conv_id, CAST(x.d AS BIGINT) AS depth, CAST(u.c AS BIGINT) AS parent_conv_id, CAST(x.n AS BIGINT) AS n_convs, CAST(coalesce(ch.n, 0) AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM linked x LEFT JOIN nodes u ON x.up = u.k LEFT JOIN children ch ON ch.k = x.k JOIN subtree s ON s.k = x.k LEFT JOIN ends e ON e.k = x.k
"""

#: The other operators learn, hash or place in ways that SQL can't express; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op4_mixing": MIXING_SQL, "op7_licenses": LICENSES_SQL, "op9_warc": WARC_SQL, "op11_trie": TRIE_SQL, "op12_resampling": RESAMPLING_SQL}
