from pyspark.sql import functions as F

from ledgerlark.operators import geometry as G
from ledgerlark.operators import store
from ledgerlark.operators.validate import low_confidence, read_checks
from ledgerlark.streaming import jobs as J


def test_versions(spark):
    log = spark.createDataFrame([(1, 1, False, "f1", "a"), (2, 1, False, "f2", "b")], "invoice_id int, version int, deleted boolean, source_filename string, buyer string")
    log = store.updated(log, spark.createDataFrame([(1, "zz", "c"), (9, "zz", "d")], "invoice_id int, source_filename string, buyer string"))
    log = store.deleted(log, spark.createDataFrame([(2,), (8,)], "invoice_id int"))
    assert [tuple(r) for r in store.latest(log).collect()] == [(1, 2, False, "f1", "c")]
    assert log.count() == 4


def test_search_and_pages(spark):
    rows = spark.createDataFrame([(i, f"n{i}", None if i % 2 else "B%c", i // 2) for i in range(60)], "invoice_id int, a string, b string, created_at int")
    assert store.search(rows, "b_C", ("a", "b")).count() == 30 and store.search(rows, "", ("a",)).count() == 60 and store.search(rows, "N5", ("a", "b")).count() == 11
    assert [r.invoice_id for r in store.page(rows, 1, 3).collect()] == [58, 59, 56] and store.page(rows, "x", 0).count() == 1 and store.page(rows, 1, 500).count() == 60
    assert [r.created_at for r in store.client_sort(rows, "created_at").limit(5).collect()] == [0, 0, 1, 1, 10]


def test_geometry(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = [(r.g, r.n, r.middle) for r in G.clusters(f([(1, v) for v in (1.0, 9.0, 17.1, 40.0, 41.0)], "g int, v double")).orderBy("middle").collect()]
    assert got == [(1, 2, 5.0), (1, 1, 17.1), (1, 2, 40.5)]
    assert G.coverage(f([(1, 0.0, 5.0), (1, 1.0, 2.0), (1, 4.0, 6.0), (1, 8.0, 9.0)], "g int, lo double, hi double")).first().covered == 7.0
    near = f([(1, i, v) for i, v in enumerate((0.0, 1.0, 1.9, 5.0))], "g int, id int, v double")
    assert [tuple(r) for r in G.largest_neighbourhood(near, 1.5).collect()] == [(1, 1, 3)]
    anchors, rules = f([(1, 0.0), (1, 20.0), (1, 40.0), (2, 0.0), (2, 20.0)], "g int, v double"), f([(1, 9.0, 0.5), (1, 11.0, 0.5), (1, 30.0, 0.4), (1, 17.0, 0.9), (2, 3.0, 0.9)], "g int, y double, covered double")
    assert sorted(tuple(r) for r in G.boundaries(anchors, rules).collect()) == [(1, 0.0, 20.0, 9.0), (1, 20.0, 40.0, 30.0)]
    cells = f([(1, 0, 0.0, 5.0), (1, 1, 5.0, 9.0)], "g int, k int, lo double, hi double")
    assert sorted(tuple(r) for r in G.containing(f([(1, 7, 5.0), (1, 8, 6.0), (1, 9, 10.0)], "g int, id int, v double"), cells).collect()) == [(1, 7, 0), (1, 8, 1)]
    assert G.grid(f([(1, 0.0), (1, 1.0), (1, 2.0)], "g int, v double"), f([(1, 0.0), (1, 3.0)], "g int, v double")).count() == 2
    b = G.bucketed_rules(f([(1, 2.9, 0.0, 4.0), (1, 3.1, 3.0, 6.0), (1, -2.0, 2.0, 5.0)], "g int, y double, lo double, hi double"))
    assert sorted(tuple(r) for r in b.collect()) == [(1, 0.0, 5.0), (1, 6.0, 3.0)]
    words = G.joined_words(f([(1, 2, "b", 90.0), (1, 1, "a", 50.0)], "cell int, pos int, text string, conf double")).first()
    assert (words.text, words.conf) == ("a b", 50.0)
    assert [r.cells for r in G.chunked(f([(1, i, str(i)) for i in range(5)], "g int, i int, cell string"), 2).orderBy("r").collect()] == [["0", "1"], ["2", "3"], ["4"]]


def test_reading_checks(spark):
    docs = spark.sql("select 1 invoice_id, 'x' extracted_text, named_struct('TTChung', named_struct('SHDon', '', 'NLap', 'd'), 'NDHDon', named_struct('DSHHDVu', array())) document")
    assert sorted(r.rule for r in read_checks(docs).collect()) == ["R10", "R9"]
    items = spark.createDataFrame([(1, 0, "1", "2", "", "", {"SLuong": 50.0, "DGia": 70.0}), (1, 1, "1", "", "", "", {})], "invoice_id int, pos int, SLuong string, DGia string, ThTien string, TThue string, confidence map<string,double>")
    assert [tuple(r) for r in low_confidence(items).collect()] == [(1, 0, ["SLuong"])]


EVENTS = [(1, 0.0, "queued", None), (1, 5.0, "running", None), (1, 9.0, "completed", None), (1, 11.0, "failed", None), (2, 0.0, "queued", None), (2, 3.0, "heartbeat", "m1"), (2, 7.0, "heartbeat", None), (3, 1.0, "heartbeat", "x"), (4, 2.0, "running", None)]


def test_jobs(spark):
    e = spark.createDataFrame(EVENTS, "job_id long, at double, kind string, message string")
    jobs, progress = J.jobs(e), J.progress(e)
    assert sorted(tuple(r) for r in jobs.collect()) == [(1, "completed", 9.0, 3609.0), (2, "queued", 0.0, 7200.0), (4, "running", 2.0, 7202.0)]
    assert sorted(tuple(r) for r in progress.collect()) == [(2, 7.0, "m1"), (3, 1.0, "x")]
    assert [r.job_id for r in J.orphans(progress, jobs).collect()] == [3]
    at = lambda now: sorted(r.job_id for r in J.stale(jobs, progress, F.lit(now)).collect())
    assert at(126.0) == [4] and at(126.5) == [4] and at(127.0) == [2, 4]
    assert J.active(jobs).first().n == 2 and not J.admitted(jobs, 2) and J.admitted(jobs, 3)
    assert sorted((r.job_id, r.status) for r in J.failed_when_stale(jobs, progress, F.lit(200.0)).collect()) == [(1, "completed"), (2, "failed"), (4, "failed")]
    assert sorted((r.job_id, r.message) for r in J.status(jobs, progress, F.lit(4000.0)).collect()) == [(2, "m1"), (4, None)]


def test_one_bad_document_does_not_end_the_job(spark):
    docs = spark.createDataFrame([(1, '{"TTKhac":[{"TTruong":"a","DLieu":1}]}'), (2, "{bad"), (3, None), (4, '[{"X":{"TTKhac":[{"TTruong":"b"},7]}}]')], "invoice_id long, document_json string")
    assert sorted(tuple(r) for r in store.shredded_extras(docs).collect()) == [(1, "HDon", "a", None, "1"), (4, "[0].X", "b", None, "")]
    assert [r.invoice_id for r in store.unreadable(docs).collect()] == [2]


def test_latest_with_maps_and_ties(spark):
    rows = [(1, 1, False, {"a": "x"}, "p"), (1, 2, False, {"a": "y"}, "q"), (1, 2, False, {"b": "z"}, "r"), (2, 1, False, {}, "s"), (2, 1, True, {}, "s")]
    log = spark.createDataFrame(rows, "invoice_id long, version int, deleted boolean, extra map<string,string>, updated_at string")
    one = store.latest(log).collect()
    assert len(one) == 1 and one[0].version == 2 and one == store.latest(log.orderBy(F.desc("updated_at"))).collect()
    changes = spark.createDataFrame([(1, "new"), (2, "gone"), (9, "none")], "invoice_id long, updated_at string")
    assert sorted(r.invoice_id for r in store.missing(log, changes).collect()) == [2, 9]
    assert store.latest(store.updated(log, changes.select("invoice_id"), now=F.lit("now"))).first().updated_at == "now"


def test_a_page_without_enough_rules_has_no_table(spark):
    pages = spark.createDataFrame([(1, 1000.0, 1000.0), (2, 1000.0, 1000.0)], "g long, width double, height double")
    rules = [(1, i, 100.0 * i, 100.0, 100.0 * i, 500.0) for i in range(7)] + [(1, 20, 0.0, 300.0, 600.0, 300.0), (2, 1, 5.0, 0.0, 5.0, 900.0)]
    found = G.ruled_table(spark.createDataFrame(rules, "g long, id long, x0 double, y0 double, x1 double, y1 double"), pages).collect()
    assert [(r.g, r.xs, r.ys) for r in found] == [(1, [100.0 * i for i in range(7)], [100.0, 300.0, 500.0])]
