import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import search, store

COLUMNS = ("invoice_number", "document_json")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("indexed"))
    rows = [(i, f"HD_{i:05d}", None if i % 7 == 0 else f"Giấy {i % 900} é{'Ab' * (i % 3)}%x \\" + (" rare" if i == 4321 else "")) for i in range(6000)]
    df = spark.createDataFrame(rows, "invoice_id long, invoice_number string, document_json string")
    search.write_indexed(df, folder, ("invoice_id",), COLUMNS, 250)
    return df, folder


def files_read(df):
    """How many files the scan of an executed plan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))


def test_trigrams(spark):
    got = spark.createDataFrame([("aBcab",), ("ab",), ("",), (None,), ("ếx😀y",)], "t string").select(search.trigrams(F.col("t")).alias("g")).collect()
    assert [r.g for r in got] == [["abc", "bca", "cab"], [], [], [], ["ếx😀", "x😀y"]]
    assert search.query_trigrams("ABC%de_fghi") == ["abc", "fgh", "ghi"] and search.query_trigrams("a%b") == []


@pytest.mark.parametrize("query", ["RARE", "hd_0432", "d_04%99", "Giấy 77", "ab", "%", "é", "x \\"])
def test_equal_to_a_full_scan(spark, indexed, query):
    df, folder = indexed
    found = search.indexed_search(spark, folder, query, COLUMNS)
    assert sorted(r.invoice_id for r in found.rows.collect()) == sorted(r.invoice_id for r in store.search(df, query, COLUMNS).collect())


def test_only_the_parts_that_can_match_are_read(spark, indexed):
    _, folder = indexed
    found = search.indexed_search(spark, folder, "rare", COLUMNS)
    assert (found.parts, found.of) == (1, 24) and files_read(found.rows) == 1
    assert search.indexed_search(spark, folder, "HD_0432", COLUMNS).parts <= 4
    whole = search.indexed_search(spark, folder, "ra", COLUMNS)
    assert whole.parts == 24 and files_read(whole.rows) == 24


def key(r):
    return (r[1] is None, -(r[1] or 0), r[2] is not None, r[2] or "", r[0])


def test_pages_equal_a_global_sort(spark):
    r = random.Random(3)
    data = [(i, None if i % 19 == 0 else 7 if i % 3 == 0 else r.randrange(500), r.choice([None, "a", "bé", "c"])) for i in range(1200)]
    df = spark.createDataFrame(data, "id long, at int, name string")
    order = (search.By("at", True), search.By("name"), search.By("id"))
    want = [x[0] for x in sorted(data, key=key)]
    for offset, size in ((0, 5), (390, 40), (1110, 60), (1190, 50), (4000, 10)):
        got = [x.id for x in search.page_rows(df, offset, size, order, 300).collect()]
        assert got == want[offset : offset + size], offset
    for offset in (10, 1170, 1198):
        last = df.filter(F.col("id") == want[offset - 1]).first().asDict()
        assert [x.id for x in search.next_page(df, last, 7, order).collect()] == want[offset : offset + 7]
    assert search.page_rows(df.limit(0), 0, 5, order).count() == 0


def test_a_page_sorts_one_range(spark):
    df = spark.range(20_000).withColumn("at", F.pmod(F.xxhash64("id"), F.lit(5000)))
    order = (search.By("at"), search.By("id"))
    pieces = search._pieces(df, 15_000, 25, order, order, 1000)
    plans = [p._jdf.queryExecution().optimizedPlan().toString() for p in pieces]
    assert len(pieces) <= 3 and all("Filter" in p and "Sort" in p for p in plans) and sum(p.count() for p in pieces) == 25


def test_many_parts_share_few_folders(spark, tmp_path, monkeypatch):
    """Folders don't grow with the rows; parts do, and searches of one part, of some and of all equal a full scan."""
    monkeypatch.setattr(search, "RUNS", 3)
    df = spark.range(3000).select(F.col("id").alias("invoice_id"), F.format_string("HD_%05d", "id").alias("invoice_number"), F.when(F.col("id") == 1234, "rare").otherwise("text").alias("document_json"))
    search.write_indexed(df.repartition(7), str(tmp_path / "i"), ("invoice_id",), COLUMNS, 50)
    assert len(list((tmp_path / "i" / "rows").glob("run=*/*.parquet"))) == 3
    for query in ("rare", "HD_0123", "00", "ext", "none such"):
        found = search.indexed_search(spark, str(tmp_path / "i"), query, COLUMNS)
        assert sorted(r.invoice_id for r in found.rows.collect()) == sorted(r.invoice_id for r in store.search(df, query, COLUMNS).collect())
        assert found.of >= 60 and found.parts == {"rare": 1, "none such": 0}.get(query, found.parts)
    assert set(found.rows.columns) == set(df.columns)
