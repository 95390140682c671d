from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlark.functions import client as C
from ledgerlark.operators import finish, tables
from ledgerlark.streaming import jobs as J

HEAD = ["STT", "Tên hàng hóa", "Đơn vị tính", "Số lượng", "Đơn giá", "Thành tiền", "Thuế suất", "Tiền thuế"]


def test_finished(spark):
    pages = spark.createDataFrame([(1, 1, "Số: 7\nNgày 1 tháng 2 năm 2024\nSTT\nThuế suất GTGT: 8%"), (1, 2, "page two"), (2, 1, "only text"), (3, 1, "")], "doc_id long, page int, text string")
    one = [HEAD, ["1", "Giấy", "Ram", "2", "50.000", "100.000", "", ""], ["", "note", "", "", "", "", "", ""], ["Tổng cộng", "100.000", "8.000", "108.000"]]
    rows = spark.createDataFrame([(1, 0, i, r) for i, r in enumerate(one)], "doc_id long, table_no int, row_idx int, cells array<string>")
    got = {r.doc_id: r for r in finish.finished(pages, rows).collect()}
    assert len(got) == 3
    first = got[1]
    assert (first.number, first.issued, first.TgTCThue, first.TgTThue, first.TgTTTBSo, first.warnings) == ("7", "2024-02-01", "100.000", "8.000", "108.000", [])
    assert [(x.TChat, x.STT, x.TSuat, x.TThue) for x in first.lines] == [("1", "1", "8%", "8.000"), ("4", "", "", "")] and [tuple(x) for x in first.rates] == [("8%", "100.000", "8.000")]
    assert got[2].warnings == ["R10", "R9"] and got[3].warnings == [] and got[2].lines is None


def test_several_tables_of_a_document_and_other_lines(spark):
    pages = spark.createDataFrame([(1, 1, "text"), (2, 1, "text")], "doc_id long, page int, text string")
    line = lambda n, amount: [n, "Giấy", "Ram", "1", amount, amount, "8%", ""]
    given = [(1, 0, 0, HEAD), (1, 0, 1, line("1", "100.000")), (1, 1, 0, line("9", "7.000")), (1, 2, 0, HEAD), (1, 2, 1, line("2", "50.000")), (1, 2, 2, ["Tổng cộng", "150.000", "12.000", "162.000"]), (1, 2, 3, line("3", "1.000"))]
    rows = spark.createDataFrame(given, "doc_id long, table_no int, row_idx int, cells array<string>")
    others = spark.createDataFrame([(1, 0, 0, "8", "no", "1"), (2, 0, 1, "2", "b", "1"), (2, 0, 0, "1", "a", "1")], "doc_id long, table_no int, row_idx int, STT string, THHDVu string, TChat string")
    got = {r.doc_id: r for r in finish.finished(pages, rows, others).collect()}
    # the columns of one table aren't in force in the next, nor below a row of totals
    assert [x.STT for x in got[1].lines] == ["1", "2"] and got[1].TgTTTBSo == "162.000"
    assert [(x.STT, x.THHDVu) for x in got[2].lines] == [("1", "a"), ("2", "b")] and got[2].TgTTTBSo == ""


def test_client(spark):
    df = spark.createDataFrame([("Ann", "a@b.c", None, {"ICO": "1", "Name": "x"}, ["a", "b"]), ("", "bad", "", {}, [])], "name string, mail string, note string, details map<string,string>, tabs array<string>")
    out = df.select(
        C.contains_any("AN", "name", "note").alias("hit"), C.all_empty("name", "note").alias("none"), C.valid_email("mail").alias("mail"), C.long_enough("name", 4).alias("long"), C.confirmed("note", "note").alias("same"),
        C.details_missing(F.lit("1"), "details").alias("gap"), C.overridden("details", "ICO", F.lit("9")).alias("over"), C.is_active("name", "Ann").alias("active"), C.tabs_for("tabs", ["b"], False).alias("tabs"),
        C.total_seconds(F.lit(1.234), F.lit(2.0)).alias("t"), C.preview(F.lit("x.PNG"), F.lit("")).alias("show"), C.languages(F.array(F.lit("eng"), F.lit("osd"), F.lit("vie"))).alias("lang"),
    ).collect()
    a, b = out
    assert (a.hit, a.none, a.mail, a.long, a.same, a.gap, a.active, a.tabs, a.t, a.show, a.lang) == (True, False, True, False, True, False, True, ["a"], 3.23, "image", "vie+eng")
    assert a.over == {"Name": "x", "ICO": "9"} and (b.hit, b.none, b.mail, b.long, b.gap) == (False, True, False, True, True)
    one = spark.sql("select 1.50 Amount, date'2024-01-02' IssueDate, named_struct('A', 'x', 'B', array(1)) rec")
    r = C.serialised(one.drop("rec")).first()
    assert r.asDict() == {"amount": "1.50", "issueDate": "2024-01-02"} and Decimal(r.amount) == Decimal("1.5")
    assert C.primitive_fields(one, "rec").columns == ["A"]


def test_swept(spark):
    jobs = spark.createDataFrame([(1, "queued", 0.0, 7200.0), (2, "completed", 0.0, 100.0)], "job_id long, status string, changed double, expires double")
    progress = spark.createDataFrame([(1, 50.0, "m"), (2, 1.0, "x"), (3, 1.0, "y")], "job_id long, heartbeat double, message string")
    alive, left = J.swept(jobs, progress, F.lit(160.0))
    assert [tuple(r)[:2] for r in alive.collect()] == [(1, "queued")] and [r.job_id for r in left.collect()] == [1]
    assert [r.status for r in J.swept(jobs, progress, F.lit(171.0))[0].collect()] == ["failed"]


def test_submitted(spark):
    jobs = spark.createDataFrame([(1, "queued", 0.0, 7200.0), (2, "completed", 0.0, 100.0)], "job_id long, status string, changed double, expires double")
    progress = spark.createDataFrame([(1, 50.0, "m")], "job_id long, heartbeat double, message string")
    wanted = spark.createDataFrame([(9,), (8,)], "job_id long")
    ids = lambda now, most: [sorted(r.job_id for r in x.collect()) for x in J.submitted(jobs, progress, wanted, F.lit(now), most)]
    assert ids(160.0, 1) == [[1], [1]] and ids(160.0, 2) == [[1, 8], [1, 8]] and ids(171.0, 1) == [[1, 8], [1, 8]] and ids(160.0, 9) == [[1, 8, 9], [1, 8, 9]]


def test_provenance_and_weak_cells(spark):
    pages = spark.createDataFrame([(1, 1, "Số: 7\nNgày lập: 1/2/2024")], "doc_id long, page int, text string")
    cells = [(HEAD, [99.0] * 8), (["1", "Giấy", "Ram", "2", "50.000", "100.000", "", ""], [99.0, 99.0, 99.0, 40.0, 99.0, 99.0, 0.0, 0.0])]
    rows = spark.createDataFrame([(1, 0, i, c, 3, "OCR", sure, [0.0, 1.0, 2.0, 3.0]) for i, (c, sure) in enumerate(cells)], "doc_id long, table_no int, row_idx int, cells array<string>, page int, method string, confidence array<double>, bbox array<double>")
    one = finish.finished(pages, rows).first()
    assert one.warnings == ["R11", "R8"] and one.lines[0].page == 3
    item = tables.items(rows.withColumnRenamed("doc_id", "table_id")).first()
    assert item.ExtractionSource.confidence["SLuong"] == 40.0 and item.ExtractionSource.bbox == [0.0, 1.0, 2.0, 3.0] and item.TTKhac[0].DLieu == "Trang 3 (OCR)"
