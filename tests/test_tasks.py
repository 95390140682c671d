from pyspark.sql import functions as F

from ledgerlark.plans import derived, invoices, layout

SF = "/root/testdata/sf0.1"


def test_texts_are_dealt_by_rows(spark):
    """150,000 orders are few bytes, but much work: no task takes more than about 20,000 of them."""
    n = invoices.invoice_texts(spark, SF).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.count("*").alias("tasks")).first()
    assert n.n <= 20_000 and n.tasks == 8


def test_pages_are_dealt_by_number(spark, monkeypatch):
    assert derived.pieces(spark.range(50_001), 1000) == 51 and derived.pieces(spark.range(3)) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(layout, "PAGES", 10)
    plan = layout.reading_order(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and not any(f"], {k}\n" in plan for k in range(1, 20))
