"""What a query works out, as its plan says it: nothing costly twice."""

import __spark_entry__ as entry
from ledgerlark.functions import scalars as S
from ledgerlark.operators import labels, tables
from ledgerlark.plans import derived

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_line_arithmetic_parses_each_number_once(spark):
    """A filter on what the numbers say isn't moved below them, where each of its tests would print and parse them again."""
    found = plan(entry.queries()["rule_line_arithmetic"](spark, SMALL))
    assert found.count("format_number(") == 3  # quantity, price, amount
    assert found.count("as decimal(38,8))") <= 6


def test_queries_keep_methods_to_what_is_compiled(spark):
    entry.queries()["table_totals"](spark, SMALL)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_tidy_cells_stay_as_they_are(spark):
    """Cells are compacted unless all of a row are tidy; what TIDY takes, compact leaves."""
    cells = ["", "a", "Cái đẹp", "a b", "a  b", " a", "a ", "a\n", "a\u00a0b", "e\u0301", "１", "\u3000", "Tổng cộng:", "a\u2009b", "1.234,50"]
    rows = spark.createDataFrame([(i, 0, [c, "x"]) for i, c in enumerate(cells)], "table_id int, row_idx int, cells array<string>")
    got = {r.table_id: r.row[0] for r in tables.analysed(rows).select("table_id", "row").collect()}
    want = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", S.compact("c").alias("c"))
    assert got == {r.i: r.c for r in want.collect()}


def test_partitions_grow_with_lines(spark, tmp_path):
    """Not in size: what is made of a line is much wider than the line."""
    lines = spark.range(1_000_000).selectExpr(
        "id div 4 as l_orderkey", "id as l_partkey", "id as l_suppkey", "cast(id % 4 as int) as l_linenumber", "1.0D as l_quantity", "2.0D as l_extendedprice", "0.0D as l_discount", "0.0D as l_tax",
        "timestamp_ntz'2024-01-01 00:00:00' as l_shipdate", "'A' as l_returnflag", "'O' as l_linestatus")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert derived.lines(spark, str(tmp_path)).rdd.getNumPartitions() == 7


def test_rows_of_tables_are_looked_at_as_one_text(spark):
    """Not cell by cell, which is interpreted, nor with Unicode's lower case; rows are made once, without a filter that makes them again; only cells of several lines go through the sort beside the row."""
    found = plan(entry.queries()["table_to_items"](spark, SMALL))
    assert "forall(" not in found and found.count("lower(") == 1 and "size(array" not in found and found.count("Tổng cộng:") == 1
    header = ["STT", "Tên hàng\x7fhóa", "Số lượng", "Đơn giá", "THÀNH TIỀN", "stt again\x7f", "\x7f"]
    rows = [(0, 0, header), (0, 1, ["1", "a/\nb", "2", "3", "4", "9", None]), (0, 2, ["", " b\x7f ", "", "", "", "", "x"]), (1, 0, [*header[:1], "(No.)", *header[2:]]), (1, 1, ["1"] * 7)]
    made = spark.createDataFrame(rows, "table_id int, row_idx int, cells array<string>")
    got = {(r.table_id, r.row_idx): (r.STT, r.THHDVu, r.TChat) for r in tables.items(made).collect()}
    assert got == {(0, 1): ("9", "a/b", "1"), (0, 2): ("", "b\x7f", "4")}
    assert made.select(tables.header_columns(made["cells"])).first()[0] == {"STT": 5, "THHDVu": 1, "SLuong": 2, "DGia": 3, "ThTien": 4}


def test_fields_of_texts_that_nobody_asks_for_are_not_worked_out(spark):
    """A document is a struct of all fields, through which Spark doesn't see: queries of a few take the columns. The head's labels are enough for a number and a date; a document's fields equal the columns."""
    assert plan(entry.queries()["read_checks"](spark, SMALL)).count("regexp_extract_all(") == 1
    assert "DOANH" not in plan(entry.queries()["finish_documents"](spark, SMALL))  # the seller's name
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["Số: 1  Ký hiệu: K\nTên đơn vị: B\nMã số thuế: 0101234567\nCộng tiền hàng: 5", "CÔNG TY A\nMã số thuế: 0101234567-001\nĐịa chỉ:\nx", "", None])], "doc_id int, text string")
    flat, whole = labels.with_fields(texts), labels.with_documents(texts).select("doc_id", "document.*")
    columns = {"_general_SHDon": "TTChung.SHDon", "_general_KHHDon": "TTChung.KHHDon", "_seller_Ten": "NDHDon.NBan.Ten", "_seller_MST": "NDHDon.NBan.MST", "_buyer_Ten": "NDHDon.NMua.Ten", "_buyer_MST": "NDHDon.NMua.MST", "_totals_TgTCThue": "NDHDon.TToan.TgTCThue"}
    assert flat.select("doc_id", *columns).collect() == whole.select("doc_id", *columns.values()).collect()
