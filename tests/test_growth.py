"""Work that is done once, or not at all, with results as before."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S
from ledgerlark.operators import store
from ledgerlark.schema import DOCUMENT
from ledgerlark.sources import documents as sources

LINE = '{"STT":"1","THHDVu":"a","TTKhac":[{"TTruong":"k","DLieu":"v"}]}'
DOCUMENTS = [
    '{"TTChung":{"SHDon":"1","NLap":2},"NDHDon":{"NBan":{"Ten":"s"},"DSHHDVu":[%s],"TToan":{"DSLPhi":["x"],"THTTLTSuat":{"LTSuat":{"TSuat":"8%%"}}}},"MCCQT":"M","DSCKS":{"a":1.50}}' % LINE,
    '{"HDon":{"DLHDon":{"TTChung":{"SHDon":"1"},"NDHDon":{"DSHHDVu":{"HHDVu":%s},"TTKhac":{"TTin":{"TTruong":"k"}}}},"MCCQT":"M"},"MCCQT":"outside"}' % LINE,
    '{"DLHDon":{"TTChung":{"SHDon":"within"},"MCCQT":"within"},"TTChung":{"SHDon":"outside"}}',
    '{"HDon":{"TTChung":{"SHDon":"1"}},"TTChung":{"SHDon":"2"}}', '{"HDon":5,"TTChung":{"SHDon":"2"}}', '{"HDon":null,"TTChung":{"SHDon":"2"}}', '{"HDon":"{\\"TTChung\\":{\\"SHDon\\":\\"3\\"}}"}',
    '{"DLHDon":[],"TTChung":{"SHDon":"2"}}', '{"DLHDon":{"TTChung":{"SHDon":"2"}},"TTChung":"text"}', '{"DLHDon":{"NDHDon":{"NMua":{"Ten":"b"}}},"NDHDon":{"NBan":"","NMua":7}}',
    '{"TTChung":{"SHDon":{"x":[1, 2]},"NLap":[ 1 ]}}', '{"TTChung":{"SHDon":"1"},"TTChung":{"NLap":"2"}}', '[{"TTChung":{"SHDon":"1"}},{"TTChung":{"SHDon":"2"}}]', "[]", "5", '"x"', "", "{", '{"TTChung":{"SHDon":"1"}} more',
    '{"NDHDon":{"DSHHDVu":"text","TTKhac":5,"TToan":{"TTKhac":[1]}}}', '{"NDHDon":{"DSHHDVu":[{"ExtractionSource":{"page":2}},null,3]}}', None,
]


def test_documents_are_read_at_once_as_level_by_level(spark):
    rows = spark.createDataFrame(list(enumerate(DOCUMENTS)), "i int, t string")
    got = rows.select("i", sources.document_of_json(F.col("t")).alias("a"), sources._by_level(F.col("t")).alias("b")).collect()
    assert [(r.i, r.a) for r in got] == [(r.i, r.b) for r in got]
    fits = {r.i for r in rows.select("i", F.from_json("t", sources.WHOLE, {"columnNameOfCorruptRecord": sources.BROKEN}).alias("x")).filter("x is not null and x._broken is null").collect()}
    assert {0, 1, 2, 3, 5, 10} <= fits and not fits & {4, 7, 8, 9}


def test_line_json_equals_the_writer(spark):
    kind = DOCUMENT["NDHDon"].dataType["DSHHDVu"].dataType.elementType
    names = [f.name for f in kind if f.dataType.simpleString() == "string"]
    lines = [{n: t for n in names} | {"TTKhac": k} for t in ("", "a, b: c", 'a "b"', "\\", "\n", "\x01", "\x7f", "é/ ", None) for k in ([], None, [{"TTruong": "t, u", "KDLieu": None, "DLieu": ":"}])] + [{"TTKhac": [], "ExtractionSource": {"page": 1}}]
    got = spark.createDataFrame([(x,) for x in lines], f"x {kind.simpleString()}").select(store.line_json(F.col("x"), kind).alias("a"), S.stored_json("x").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and len(got) == 28


@pytest.mark.parametrize("text, paths", [
    ('{"TTKhac":[{"TTruong":"a"}],"A":{"TTKhac":[1],"B":{"TTKhac":[{"TTruong":"b"}]}}}', ["HDon", "A.B"]),
    ('{"A":[[{"TTKhac":[{"TTruong":"a","TTKhac":[{"TTruong":"b"}]}]}]]}', ["A[0][0]", "A[0][0].TTKhac[0]"]),
    ('{"s":"\\"TTKhac\\":[1","A":{"TTKhac" : [ {"TTruong":"a"} ]}}', ["A"]),
    ('{"A":{"B":{"\\u0054TKhac":[{"TTruong":"a"}]}},"TTKhac":[{"TTruong":"b"}]}', ["HDon", "A.B"]),
    ('{"TTKhac":{"TTKhac":[{"TTruong":"a"}]},"A":{"TTKhac":[]}}', ["TTKhac"]),
])
def test_all_extra_groups_are_found(spark, text, paths):
    rows = spark.createDataFrame([(1, text)], "invoice_id int, document_json string")
    assert sorted(r.group_path for r in store.shredded_extras(rows).collect()) == sorted(paths)


def test_a_text_is_walked_from_one_parse(spark):
    """The check of the text names it twice, the walk once more."""
    rows = spark.createDataFrame([(1, "{}")], "invoice_id int, document_json string")
    plan = store.shredded_extras(rows)._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(") == 3 and "translate(" not in plan
