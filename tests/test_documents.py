import json
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import labels, store, tables, validate
from ledgerlark.plans import details
from ledgerlark.schema import DOCUMENT, template
from ledgerlark.sources import documents as D

TEXT = """CÔNG TY TNHH ABC
Mã số thuế: 0101234567
Địa chỉ: 1 Lê Lợi
Ký hiệu: 1C24TAA   Số: 00000123
Ngày 05 tháng 3 năm 2024
Họ tên người mua hàng: Nguyễn Văn A
Tên đơn vị: Công ty XYZ
Mã số thuế: 0309876543-001
STT
Cộng tiền hàng: 1.000.000
Tiền thuế GTGT: 100.000
Tổng cộng tiền thanh toán: 1.100.000"""


def document_of(spark, text):
    made = labels.text_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return json.loads(made.document_json)


def test_text_invoice(spark):
    d = document_of(spark, TEXT)
    general, content = d["TTChung"], d["NDHDon"]
    assert (general["KHHDon"], general["SHDon"], general["NLap"], general["DVTTe"]) == ("1C24TAA", "00000123", "2024-03-05", "VND")
    assert (content["NBan"]["Ten"], content["NBan"]["MST"], content["NBan"]["DChi"]) == ("CÔNG TY TNHH ABC", "0101234567", "1 Lê Lợi")
    assert (content["NMua"]["HVTNMHang"], content["NMua"]["Ten"], content["NMua"]["MST"]) == ("Nguyễn Văn A", "Công ty XYZ", "0309876543-001")
    assert (content["TToan"]["TgTCThue"], content["TToan"]["TgTThue"], content["TToan"]["TgTTTBSo"]) == ("1.000.000", "100.000", "1.100.000")
    assert content["DSHHDVu"] == []


@pytest.mark.parametrize(
    ("text", "continued", "want"),
    [
        ("Số: 1 Ký hiệu: AB", False, [("number", "1"), ("series", "AB")]),
        ("Địa chỉ (Address):\n\n  2 Trần Phú", False, [("address", "2 Trần Phú")]),
        ("Địa chỉ:\nSố: 5", False, [("address", ""), ("number", "5")]),
        ("Đơn vị bán hàng: A\nB C\nGhi chú x\nD", True, [("seller", "A B C D")]),
        ("xSố: 1", False, []),
        ("Dia chi： q", False, [("address", "q")]),
        ("", False, []),
        ("Địa chỉ: 1 Lê Lợi\u2028Quận 1\nSố: 5", True, [("address", "1 Lê Lợi Quận 1"), ("number", "5")]),
        ("Địa chỉ: A\nA\nB: C", True, [("address", "A")]),
        (unicodedata.normalize("NFD", "Mã số thuế: 01 Điện thoại: 02"), False, [("tax", "01"), ("phone", "02")]),
        ("Điện thoại:\n \n\t\nx\x01y Email: z", False, [("phone", ""), ("email", "z")]),
    ],
)
def test_label_pairs(spark, text, continued, want):
    rows = labels.label_values(spark.createDataFrame([(1, text)], "doc_id long, text string"), continued).collect()
    assert [(r.label, r.value) for r in sorted(rows, key=lambda r: r.pos)] == want


def test_document_edges(spark):
    assert document_of(spark, "") == document_of(spark, None) == template()
    d = document_of(spark, "Số tài khoản: 12 Ngân hàng ACB\nMã số thuế: 12\nNgày lập: 31/2/2024\nMã CQT: M1-2")
    assert (d["NDHDon"]["NBan"]["STKNHang"], d["NDHDon"]["NBan"]["MST"], d["TTChung"]["NLap"], d["MCCQT"]) == ("12", "", "", "M1")
    after = spark.range(1).select(labels.value_after(F.lit("a\nCustom (x): v  Số: 1"), "custom").alias("a"), labels.value_after(F.lit("other: 1"), "x").alias("b"), labels.value_after(F.lit("b: 2\na: 1"), "a", "b").alias("c")).first()
    assert tuple(after) == ("v", "", "2")


def test_readers(spark):
    items = "<HHDVu><STT>1</STT></HHDVu><HHDVu><STT>2</STT></HHDVu>"
    xml = lambda inner: f'<a:HDon xmlns:a="u"><DLHDon k="1"><NDHDon><DSHHDVu>{inner}</DSHHDVu></NDHDon></DLHDon></a:HDon>'.encode()
    rows = [
        ("two.xml", xml(items), None), ("one.xml", xml("<HHDVu><STT>1</STT></HHDVu>"), None), ("bad.xml", b"<a>", None), ("empty.json", b"", None), ("list.json", b"[1]", None),
        ("bad.json", b"{", None), ("d.json", '﻿{"TTChung":{"SHDon":"9","X":1},"NDHDon":{"TToan":{"THTTLTSuat":{"LTSuat":{"TSuat":"8%"}}},"TTKhac":{"TTin":{"TTruong":"t"}}}}'.encode(), None),
        ("t.txt", TEXT.encode(), None), ("p.pdf", b"%PDF", None), ("x.bin", b"1", None), ("y", b"{}", "application/json"),
    ]
    got = {r.path: r for r in D.parsed(spark.createDataFrame(rows, "path string, content binary, content_type string")).collect()}
    assert len(got) == len(rows)
    stt = lambda p: [x.STT for x in got[p].document.NDHDon.DSHHDVu]
    assert stt("two.xml") == ["1", "2"] and stt("one.xml") == ["1"] and '"@k"' in got["one.xml"].document_json
    assert got["bad.xml"].error and got["bad.json"].error == "not valid JSON" and got["empty.json"].error == "the file is empty"
    assert got["list.json"].document.NDHDon.DSHHDVu == [] and got["list.json"].error is None
    assert got["d.json"].document.TTChung.SHDon == "9" and got["d.json"].document.NDHDon.TToan.THTTLTSuat[0].TSuat == "8%" and got["d.json"].document.NDHDon.TTKhac[0].TTruong == "t"
    assert got["t.txt"].document.TTChung.SHDon == "00000123" and got["p.pdf"].warnings and got["x.bin"].parser == "unknown" and got["y"].parser == "json"


def test_page_reader_and_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "big.txt").write_bytes(b"y" * 100)
    found = D.files(spark, str(tmp_path), most=50)
    assert sorted((r.path.rsplit("/", 1)[1], r.content is None, bool(r.error)) for r in found.collect()) == [("a.pdf", False, False), ("big.txt", True, True)]
    assert [r.error for r in D.parsed(found).filter("parser = 'text'").collect()] == ["the file is larger than 50 bytes"]
    latin = spark.createDataFrame([("l.txt", "Số: 5 é".encode("utf-8")[:-2] + b"\xe9\nSerial: X", None), ("l.json", b'{"a":"\xe9"}', None), ("g.html", "Số: 6".encode(), None)], "path string, content binary, content_type string")
    read = {r.path: r for r in D.parsed(latin).collect()}
    assert "\ufffd" in read["l.txt"].extracted_text and read["l.txt"].document.TTChung.KHHDon == "X" and read["l.json"].error == "not valid JSON"
    reader = lambda df: df.select("path", F.lit("seen").alias("extracted_text"), F.lit(json.dumps({"MCCQT": "M"})).alias("document_json"))
    r = D.parsed(found, use_ocr=True, page_reader=reader).filter("parser = 'pdf'").first()
    assert (r.extracted_text, r.document.MCCQT, r.ocr_engine) == ("seen", "M", "tesseract")


ITEM = "invoice_id int, pos int, TChat string, STT string, SLuong string, DGia string, TLCKhau string, STCKhau string, ThTien string, TThue string, TSuat string"


def rules(spark, items, totals):
    i = spark.createDataFrame(items, ITEM)
    t = spark.createDataFrame(totals, "invoice_id int, TgTCThue string, TgTThue string, TgTTTBSo string")
    return {(r.invoice_id, r.rule): r.times for r in validate.findings(i, t).collect()}


def test_validation(spark):
    items = [(1, 0, "1", "1", "2", "100.000", "", "", "200.000", "20.000", "10%"), (1, 1, "1", "1", "1", "50.000", "", "", "60.000", "", "10%")]
    assert rules(spark, items, [(1, "260.001", "20.000", "280.003")]) == {(1, "R1"): 1, (1, "R3"): 1, (1, "R4"): 1, (1, "R7"): 1}
    assert rules(spark, [(2, 0, "4", "", "", "", "", "", "", "", "")], [(2, "", "", "x")]) == {(2, "R8"): 1}
    assert rules(spark, [(3, 0, "1", "", "1", "1", "5", "", "9", "1", ""), (3, 1, "1", None, "1", "5", "", "3", "2", "1", "")], [(3, "11", "5", "16")]) == {(3, "R1"): 1, (3, "R6"): 1}
    assert rules(spark, [(4, 0, "1", "1", "x", "1", "", "", "1", "", "")], [(4, "1", "", "1")]) == {(4, "R2"): 1}


TABLE = "table_id int, row_idx int, cells array<string>"
HEAD = ["STT", "Tên hàng hóa", "Đơn vị tính", "Số lượng", "Đơn giá", "Thành tiền"]


def test_tables(spark):
    rows = [
        ["1", "before any header", "", "1", "1", "1"], HEAD, ["(1)", "(2)", "", "", "", ""], ["1", "Giấy/\n A4", "Ram", "2", "50.000", "100.000"], ["", "Ghi chú giao hàng", "", "", "", ""],
        ["a", "odd", "", "1", "", ""], ["", "", "", "", "", ""], ["Thuế suất 8 %:", "100.000", "8.000", "108.000"], ["Thuế suất 8 %:", "100.000", "8.000", "108.000"],
        ["Cộng tiền hàng", "100.000"], ["2", "after the reset", "", "1", "1", "1"], ["x", "Tiền thuế GTGT", "8.000"], ["Tổng cộng", "1", "2", "3"],
    ]
    t = spark.createDataFrame([(1, i, r) for i, r in enumerate(rows)] + [(2, 0, ["No header", "x"])], TABLE)
    got = [(r.row_idx, r.STT, r.THHDVu, r.ThTien, r.TChat, r.unclear) for r in tables.items(t).orderBy("row_idx").collect()]
    assert got == [(3, "1", "Giấy/A4", "100.000", "1", False), (4, "", "Ghi chú giao hàng", "", "4", False), (5, "a", "odd", "", "", True), *[(n, "Thuế suất 8 %:", "100.000", "", "", True) for n in (7, 8)]]
    one = {r.table_id: r for r in tables.totals(t).collect()}
    assert (one[1].TgTCThue, one[1].TgTThue, one[1].TgTTTBSo) == ("1", "2", "3") and [tuple(x) for x in one[1].rates] == [("8%", "100.000", "8.000")]
    assert one[2].rates == [] and {r.table_id for r in tables.bearing_headers(t).collect()} == {1}
    english = spark.createDataFrame([(1, 0, ["(No.)", "Description of goods", "(Unit)", "Quantity", "Unit price", "(Amount)"]), (1, 1, ["STT", "Đơn giá"])], TABLE)
    found = [r.c for r in english.select(tables.header_columns(F.col("cells")).alias("c")).collect()]
    assert found == [{"STT": 0, "THHDVu": 1, "DVTinh": 2, "SLuong": 3, "DGia": 4, "ThTien": 5}, None]


def test_markdown(spark):
    text = "| STT | Tên |\n| --- | :---: |\n| 1 | **Giấy** \\| A&amp;B<br>x |\n| | note |\n|| edge ||\nend\n\na | b\n--- | ---\n1 | 2\n3 | 4 | 5"
    got = [(r.table_no, r.row_idx, r.cells) for r in tables.markdown_tables(spark.createDataFrame([(1, text)], "page_id int, text string")).orderBy("table_no", "row_idx").collect()]
    assert got == [(0, 0, ["STT", "Tên"]), (0, 1, ["1", "Giấy | A&B\nx"]), (0, 2, ["", "note"]), (1, 0, ["a", "b"]), (1, 1, ["1", "2"])]


def test_shredding_and_core_fields(spark):
    doc = template()
    doc["TTChung"] |= {"SHDon": "7", "NLap": "1/2/2024"}
    doc["NDHDon"]["TToan"]["TgTTTBSo"] = "1.100.000"
    doc["NDHDon"]["DSHHDVu"] = [{"STT": "x", "SLuong": "1,5", "ThTien": "10", "TTKhac": [{"TTruong": "a", "KDLieu": "n", "DLieu": 0}]}, {"STT": "9"}]
    doc["TTKhac"] = [{"TTruong": "r", "DLieu": "v"}, "skip"]
    raw = json.dumps(doc)
    d = spark.createDataFrame([(1, raw)], "invoice_id long, document_json string").withColumn("document", D.document_of_json(F.col("document_json")))
    assert d.schema["document"].dataType.simpleString().count("TTruong") == DOCUMENT.simpleString().count("TTruong")
    core = store.core_fields(d, typed=True).first()
    assert core.invoice_number == "7" and str(core.issue_date) == "2024-02-01" and core.grand_total == 1100000 and core.subtotal is None and core.buyer_name == ""
    assert [(r.line_number, r.quantity and float(r.quantity)) for r in store.shredded_items(d).collect()] == [(1, 1.5), (9, None)]
    assert sorted(tuple(r)[1:] for r in store.shredded_extras(d).collect()) == [("HDon", "r", None, "v"), ("NDHDon.DSHHDVu[0]", "a", "n", "")]


def nested_xml(levels):
    return ("<a>" * levels + "x" + "</a>" * levels).encode()


def test_nothing_nested_ends_the_job(spark):
    """Every reader gives a row for 200,000 levels of XML or JSON: an error, or no entries."""
    deep = "[" * 200_000 + "]" * 200_000
    files = spark.createDataFrame([("a.xml", nested_xml(5000)), ("b.xml", nested_xml(200_000)), ("c.json", ('{"x":' + deep + "}").encode()), ("d.xml", nested_xml(400)), ("e.txt", deep.encode()), ("f.json", b'{"TTChung":{"SHDon":"1"}}')], "path string, content binary")
    got = {r.path: r for r in D.parsed(files).select("path", "error", F.col("document.TTChung.SHDon").alias("n")).collect()}
    assert {p for p, r in got.items() if r.error} == {"a.xml", "b.xml", "c.json"} and "500 levels" in got["a.xml"].error and got["f.json"].n == "1"
    docs = spark.createDataFrame([(1, deep), (2, '{"TTKhac":' + deep + "}"), (3, '{"X":' * 900 + '{"TTKhac":[{"TTruong":"t"}]}' + "}" * 900)], "invoice_id long, document_json string")
    assert [(r.invoice_id, r.group_path.count("X"), r.field_name) for r in store.shredded_extras(docs).collect()] == [(3, 900, "t")]
    assert sorted(r.invoice_id for r in store.unreadable(docs).collect()) == [1, 2]


def test_extra_fields_as_they_are_stored(spark):
    values = ['"0"', "0", "0.0", "1.50", "true", "false", "null", '""', "[]", "{}", '[1]', '{"a": "b"}', '"x"']
    raw = '{"A.b":{"TTKhac":[%s, 5, []]},"TTKhac":{"TTruong":"no list"},"L":[[{"TTKhac":[{"TTruong":7,"KDLieu":true,"DLieu":"v","TTKhac":[{"TTruong":"in"}]}]}]]}' % ",".join(f'{{"TTruong":"t{i}","DLieu":{v}}}' for i, v in enumerate(values))
    got = sorted(tuple(r)[1:] for r in store.shredded_extras(spark.createDataFrame([(1, raw), (2, "5"), (3, '"TTKhac"')], "invoice_id long, document_json string")).collect())
    want = ["0", "", "", "1.5", "True", "", "", "", "", "", "[1]", '{"a":"b"}', "x"]
    rows = [("A.b", f"t{i}", None, v) for i, v in enumerate(want)] + [("L[0][0]", "7", "True", "v"), ("L[0][0].TTKhac[0]", "in", None, "")]
    assert got == sorted(rows)


def test_xml_trees():
    tree = D.xml_tree(b'<?xml version="1.0" encoding="ISO-8859-1"?><n:A xmlns:n="u" k="1"> t <B n:z="2">\xe9 <!-- c -->&amp;<![CDATA[<]]></B>tail<B/><C q="3"><D> </D></C></n:A>')
    assert tree == {"A": {"B": ["é &<", ""], "C": {"D": "", "@q": "3"}, "@k": "1"}}


def test_json_ends_with_its_value(spark):
    """Spark's parser takes the first value of ``12 fox`` and leaves the rest."""
    bad = ["12 fox", '{"a":1} x', '{"a":1}{"b":2}', "1, 2", '1, "y": 2', "1] , [2", "1}, {2", "[1]]", '{"x":1}}', "null null", '"a" "b"', "1,", "", " ", ",", ":"]
    good = ["12", ' {"a":1}\n', "[1]", "null", '"a"', "-1.5e3 ", "true"]
    df = spark.createDataFrame([(f"{i}.json", t.encode(), i < len(bad)) for i, t in enumerate(bad + good)], "path string, content binary, bad boolean")
    got = D.parsed(df).join(df.select("path", "bad"), "path").select("path", "bad", "error").collect()
    assert len(got) == len(bad + good) and {r.path for r in got if r.bad != (r.error is not None)} == set()
    entry = '{"TTKhac":[{"TTruong":"t","KDLieu":"s","DLieu":"v"}]}'
    texts = spark.createDataFrame([(1, entry), (2, entry + " more"), (3, None)], "invoice_id int, document_json string")
    assert [r.invoice_id for r in store.shredded_extras(texts).collect()] == [1] and [r.invoice_id for r in store.unreadable(texts).collect()] == [2]


def test_documents_as_files_equal_their_sql_whatever_they_say(spark, tmp_path):
    """Texts that are JSON, empty, missing, or begin with a byte order mark, each as broken JSON, as text and with a byte that isn't UTF-8."""
    texts = ["4703443633947811", '{"a": 1}', "[1]", '"a"', " null ", "true", "NaN", "", " ", None, "\ufeffx", "\ufeff", "a {", "{", '{"a": 1', "é", "\ufffd", "12 fox"]
    rows = [(66 * i + k, text) for i, text in enumerate(texts) for k in (0, 1, 2, 3, 11)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in details.parsed_files(spark, str(tmp_path)).select("path", "parser", "text", "error").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    order = lambda found: sorted(tuple(map(str, r)) for r in found)
    assert order(got) == order(con.execute(f"SELECT path, parser, text, error FROM ({details.PARSED_SQL})").fetchall()) and len(got) == len(rows)
