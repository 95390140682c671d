from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S

# input, strict, lenient
NUMBERS = [
    ("1.234.567", "1234567", "1234567"), ("1.234.567,50", "1234567.50", "1234567.50"), ("1,234,567.50", None, "1234567.50"), ("1,5", "1.5", "1.5"),
    ("1.5", None, "1.5"), ("1,234", "1.234", "1234"), ("1.234", "1234", "1234"), ("1 000", "1000", "1000"), ("-1.000", "-1000", "-1000"), ("abc", None, None),
    ("", None, None), (None, None, None), ("10%", None, "10"), ("1.000 ₫", None, "1000"), ("1.000VND", None, "1000"), ("1.000đ", None, "1.000"), ("0.125", "125", "125"),
    ("10000.000", None, "10000000"), ("12-3", None, None), ("(5)", None, "5"), ("1e3", None, "13"), (",5", None, "0.5"),
]


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string").select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)])
    return [tuple(r)[1:] for r in sorted(df.collect())]


def test_numbers(spark):
    got = values(spark, [n for n, *_ in NUMBERS], S.decimal_strict("v"), S.decimal_lenient("v"))
    dec = lambda x: None if x is None else Decimal(x)
    assert got == [(dec(a), dec(b)) for _, a, b in NUMBERS]


def test_dates(spark):
    cases = {"2024-01-02T10:00": date(2024, 1, 2), "1/2/2024": date(2024, 2, 1), "05-03-2024": date(2024, 3, 5), "1/2/2024 10:00": None, "31/02/2024": None, "": None, "2024-1-2": date(2024, 1, 2)}
    assert [v for v, in values(spark, list(cases), S.date_any("v"))] == list(cases.values())
    spoken = {"Ngày 05 tháng 3 năm 2024": "2024-03-05", "Ngày (Date) 5 tháng (month) 12 năm (year) 2023": "2023-12-05", "Ngày 31 tháng 2 năm 2024": "", "x": None}
    assert [v for v, in values(spark, list(spoken), S.spoken_date("v"))] == list(spoken.values())


def test_texts(spark):
    assert values(spark, [" a　\tb \x1c c ", None], S.compact("v")) == [("a b c",), ("",)]
    assert values(spark, ["Đà Nẵng – Cộng tiền hàng", "Ünïcödé ß"], S.fold_accents("v")) == [("Da Nang – Cong tien hang",), ("Unicode ß",)]
    assert values(spark, ["0101234567-001 x", "0101234567", "01012345678"], S.tax_code("v")) == [("0101234567-001",), ("0101234567",), ("",)]
    assert values(spark, ["12 ", "1.0", "", None, "x", "-3"], S.integer_or("v", F.lit(7))) == [(12,), (7,), (7,), (7,), (7,), (-3,)]
    assert values(spark, ["12345 Ngân hàng ACB |", "12345"], *S.account_and_bank("v")) == [("12345", "ACB"), ("12345", None)]
    assert values(spark, ["HD/ \n 12", "a/\nb c"], S.rejoined("v")) == [("HD/12",), ("a/b c",)]
    assert values(spark, ["# T\n![i](u)**b** [l](u) \\|"], S.markdown_to_text("v")) == [("T\nb l |",)]
    assert values(spark, ["a  b\r\n\r\n\r\nc\f d "], S.readable_pages("v")) == [("a b\n\nc\n\n────────\n\nd",)]
    assert values(spark, ["{ns}Ten", "Ten"], S.local_name("v")) == [("Ten",), ("Ten",)]
    assert values(spark, ["Thuế suất 8,5 %", "x"], S.percent("v")) == [("8,5%",), (None,)]
    assert values(spark, ["é"], S.nfc("v")) == [("é",)] and values(spark, ["&eacute;&lt;"], S.html_unescaped("v")) == [("é<",)]
    assert values(spark, ["A%b", "AXB", "É\\b"], S.like_ascii("v", "a_b"), S.like_ascii("v", "\\B")) == [(True, False), (True, False), (False, True)]
    assert values(spark, ["word " * 12, "word " * 9, "� " * 60], S.usable_text("v")) == [(True,), (False,), (False,)]


def test_readers(spark):
    files = ["a.XML", "a.json", "x.pdf", "p.JPG", "t.csv", "t", "dir.xml/file"]
    assert values(spark, files, S.reader("v")) == [("xml",), ("json",), ("pdf",), ("image",), ("text",), ("unknown",), ("unknown",)]
    assert values(spark, ["t"], S.reader("v", F.lit("text/xml")), S.reader("v", F.lit("text/plain")), S.reader("v", None, True)) == [("xml", "text", "image")]
    with pytest.raises(ValueError):
        S.checked_engine("other")


def test_stored_json(spark):
    import json

    values = ['a"b\\,: ', "x" * 5000, '"' * 3000, "é,:", "", None]
    rows = spark.createDataFrame([(v, None, {"k,": "v:"}, [1, 2]) for v in values], "a string, b string, m map<string,string>, l array<int>")
    got = [r.j for r in rows.select(S.stored_json(F.struct("a", "b", "m", "l")).alias("j")).collect()]
    assert got == [json.dumps({"a": v, "b": None, "m": {"k,": "v:"}, "l": [1, 2]}, ensure_ascii=False) for v in values]
