"""Tables of a page to invoice lines and totals, and tables in Markdown text.

A table is rows of cells in long form: table_id, row_idx, cells (array<string>). What a row does to the column map (set, reset, nothing) depends on
the row alone, so it is computed first; the map in force is then the last one set since the last reset, a running window per table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import BETWEEN, LINE_END, TIDY, accent_folds, compact, decimal_strict, html_unescaped, let, rejoined

# Header labels of the columns, and the English wordings that only fill what those leave open.
LABELS = [
    ("STT", "STT"), ("Tên hàng", "THHDVu"), ("Đơn vị", "DVTinh"), ("Số lượng", "SLuong"), ("Đơn giá", "DGia"), ("Thành tiền", "ThTien"),
    ("Thuế suất", "TSuat"), ("Tiền thuế", "TThue"), ("Tỷ lệ chiết khấu", "TLCKhau"), ("Tiền chiết khấu", "STCKhau"),
]
ENGLISH = [("STT", r"\bstt\b|\(no\.?\)"), ("THHDVu", r"\bdescription\b"), ("DVTinh", r"\(unit\)"), ("SLuong", r"\bquantity\b"), ("DGia", r"\bunit price\b"), ("ThTien", r"\(amount\)")]
NEEDED = ["STT", "THHDVu", "SLuong", "DGia", "ThTien"]
FIELDS = [f for _, f in LABELS]
TOTALS = ("TgTCThue", "TgTThue", "TgTTTBSo")
#: What a header row holds somewhere (STT in any accents, or its English wording); what a row of totals or rates holds.
#: Both cases are written out: looking for them with a flag costs several times as much, and every row is looked at.
_S, _T = "[sS\u017f\u015a-\u0161\u0218\u0219]", "[tT\u0162-\u0165\u021a\u021b]"
MAY_BE_HEADER = rf"{_S}\p{{M}}*{_T}\p{{M}}*{_T}|\([nN][oO]\.?\)"
MAY_BE_TOTAL = "[tT](?:[ổỔ][nN][gG]|[hH][uU][ếẾ])|[cC][ộỘ][nN][gG]"

#: The letters of the words that totals and rates begin with: lowering these alone costs much less than all of Unicode.
STATED = "acghinostuàáưấếềổộ"


def folded(c: Column) -> Column:
    """Without accents, and in small letters as far as labels have them: those that become a to z."""
    accented, plain = accent_folds()
    return F.regexp_replace(F.translate(c, accented + ascii_uppercase + "\u212a", plain.lower() + ascii_lowercase + "k"), r"\p{Mn}+", "")


def header_columns(cells: Column) -> Column:
    """Field to column number (from 0) if the row is a header, else null. Of several columns with a field's label the last
    counts; an English wording fills a field that no label before or in that cell has set, or that none sets at all."""
    # no header without a line number column: one look at the row spares most rows the search
    return F.when(F.rlike(F.array_join(cells, " ", ""), F.lit(MAY_BE_HEADER)), let(F.transform(cells, compact), _header))


def _as_text(cells: Column) -> Column:
    """Folded cells as one text, each behind BETWEEN, which none of them keeps."""
    return F.concat(F.lit(BETWEEN), F.array_join(F.transform(cells, lambda c: F.translate(folded(c), BETWEEN, "\1")), BETWEEN))


def _numbers_of(row: Column, text: Column) -> Column:
    """For each field the number of its cell in a row of compact cells, null without one. Labels are looked for in ``_as_text`` of the row: behind the last of a label, the cells that follow are counted."""
    out = []
    for label, field in LABELS:
        mark = BETWEEN + _plain(label)
        behind = F.substring_index(text, mark, -1)
        at = F.when(F.contains(text, F.lit(mark)), F.size(row) - 1 - F.octet_length(behind) + F.octet_length(F.replace(behind, F.lit(BETWEEN), F.lit(""))))
        for pattern in (p for f, p in ENGLISH if f == field):
            at = F.coalesce(at, F.array_min(_places(row, _holding(pattern))))
        out.append(at)
    return F.array(*out)


def _by_field(numbers: Column) -> Column:
    """Field to number if all that are needed have one."""
    needed = reduce(lambda a, b: a & b, [F.get(numbers, F.lit(FIELDS.index(f))).isNotNull() for f in NEEDED])
    entries = F.array(*[F.struct(F.lit(f).alias("k"), F.get(numbers, F.lit(k)).alias("v")) for k, f in enumerate(FIELDS)])
    return F.when(needed, F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())))


def _header(row: Column) -> Column:
    """``header_columns`` of a row of compact cells."""
    return let(_as_text(row), lambda text: let(_numbers_of(row, text), _by_field))


def _starting(prefix: str) -> Callable[[Column], Column]:
    return lambda cell: F.startswith(cell, F.lit(prefix))


def _holding(pattern: str) -> Callable[[Column], Column]:
    return lambda cell: F.rlike(cell, F.lit(f"(?iu){pattern}"))


def _places(cells: Column, test: Callable[[Column], Column]) -> Column:
    """The numbers of the cells that pass."""
    return F.filter(F.transform(cells, lambda c, i: F.when(test(c), i)), lambda i: i.isNotNull())


def _plain(label: str) -> str:
    text = label.replace("đ", "d").replace("Đ", "D")
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def analysed(tables: DataFrame, by: str = "table_id", table: str | None = None) -> DataFrame:
    """Each row with what it is: its header map, the total or rate that it states, whether it resets the columns, and the columns in force; ``raw`` is its cells if one has several lines. Rows are shuffled by ``by``; where that may hold several
    tables, ``table`` tells them apart, and no columns of one are in force in another."""
    # a row is looked at as one text, as what goes through its cells one by one costs many times as much; only rows that may state totals have their filled cells gone through
    row = tables.withColumn("_text", F.array_join("cells", BETWEEN, "  ")).withColumn("_bare", F.replace("_text", F.lit(BETWEEN), F.lit("")))
    row = row.withColumn("_tidy", (F.octet_length("_text") - F.octet_length("_bare") == F.size("cells") - 1) & F.rlike("_text", F.lit(TIDY)))
    row = row.withColumn("row", F.when(F.col("_tidy"), F.col("cells")).otherwise(F.transform("cells", compact))).withColumn("raw", F.when(F.contains("_text", F.lit("\n")), F.col("cells")))
    plain = F.when(F.col("_tidy"), F.concat(F.lit(BETWEEN), folded(F.col("_text")))).otherwise(_as_text(F.col("row")))
    row = row.withColumn("_plain", F.when(F.rlike("_text", F.lit(MAY_BE_HEADER)), plain))
    row = row.withColumn("_numbers", F.when(F.col("_plain").isNotNull(), _numbers_of(F.col("row"), F.col("_plain")))).withColumn("header", _by_field(F.col("_numbers")))
    row = row.withColumn("_text", F.when(F.col("_tidy"), F.col("_text")).otherwise(F.array_join("row", " "))).withColumn("_any", F.when(F.col("_tidy"), F.col("_bare") != "").otherwise(F.trim("_text") != ""))
    row = row.withColumn("filled", F.when(F.rlike("_text", F.lit(MAY_BE_TOTAL)), F.array_remove("row", "")).otherwise(F.array().cast("array<string>")))
    row = row.withColumn("first", F.when(F.size("filled") > 0, F.translate(F.get("filled", F.lit(0)), STATED.upper(), STATED)).otherwise(""))
    row = row.withColumn("numbers", F.filter(F.slice("filled", 2, F.greatest(F.lit(0), F.size("filled") - 1)), lambda c: decimal_strict(c).isNotNull()))
    n, first, plain = F.size("numbers"), F.col("first"), F.col("header").isNull() & F.coalesce("_any", F.lit(False))
    starts = lambda *texts: reduce(lambda a, b: a | b, [F.startswith(first, F.lit(t)) for t in texts])
    three = plain & starts("tổng cộng") & (n == 3)
    one = plain & ~three & (n == 1)
    subtotal, total = one & starts("cộng tiền hàng", "tổng tiền chưa thuế"), one & starts("tổng cộng tiền thanh toán", "tổng tiền thanh toán")
    tax = one & F.exists("filled", lambda c: F.startswith(F.lower(c), F.lit("tiền thuế gtgt")))
    rate = F.regexp_extract(F.coalesce(F.get("filled", F.lit(0)), F.lit("")), r"(\d+(?:,\d+)?)[ \t]*%", 1)
    rated = plain & ~three & starts("thuế suất") & (n == 3) & (rate != "")
    number = lambda i: F.get("numbers", F.lit(i))
    row = row.select(
        *tables.columns, "row", "raw", "header", plain.alias("plain"),
        F.when(three, number(0)).when(subtotal, number(0)).alias("TgTCThue"),
        F.when(three, number(1)).when(tax, number(0)).alias("TgTThue"),
        F.when(three, number(2)).when(total, number(0)).alias("TgTTTBSo"),
        F.when(rated, F.struct(F.concat(rate, F.lit("%")).alias("TSuat"), number(0).alias("ThTien"), number(1).alias("TThue"))).alias("rate"),
        three.alias("ends"), (three | subtotal | total | tax).alias("resets"),
    )
    own = F.col(table) if table else F.lit(0)
    event = F.when(F.col("header").isNotNull(), F.struct(own.alias("table"), F.col("header").alias("columns"))).when(F.col("resets"), F.struct(own.alias("table"), F.lit(None).cast("map<string,int>").alias("columns")))
    upto = W.partitionBy(by).orderBy(*([table] if table else []), "row_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    row = row.withColumn("columns", F.last(event, ignorenulls=True).over(upto))
    return row.withColumn("columns", F.when(F.col("columns.table").eqNullSafe(own), F.col("columns.columns")))


def items(tables: DataFrame) -> DataFrame:
    """table_id, row_idx, the item fields, TChat (1 goods, 4 note, empty if unclear) and unclear (a row with amounts but no line number). Of tables that say where they come from (column
    ``page``, perhaps ``method``, and by row ``confidence``, one number a cell, and ``bbox``) also ExtractionSource and the entry in TTKhac that names it."""
    sourced = [c for c in ("page", "method", "confidence", "bbox") if c in tables.columns]
    rows = analysed(tables).filter(MAY_BE_LINE).select("table_id", "row_idx", "raw", "columns", *sourced, *cells_by_field())
    is_line, line = _line()
    return rows.filter(is_line).select("table_id", "row_idx", *line, *(_provenance(sourced) if "page" in sourced else []))


#: Of the rows of ``analysed``, those that stand below a header and are neither empty nor the end of a table.
MAY_BE_LINE = "plain and not ends and columns is not null"


def cells_by_field() -> list[Column]:
    """The cell of each item field in a row of ``analysed``, empty where there is none."""
    return [F.coalesce(F.get("row", F.try_element_at("columns", F.lit(f))), F.lit("")).alias(f) for f in FIELDS]


def _line() -> tuple[Column, list[Column]]:
    """Whether a row with ``cells_by_field`` is a line of the invoice, and the columns of that line."""
    amounts = reduce(lambda a, b: a | b, [F.col(f) != "" for f in ("SLuong", "DGia", "ThTien")])
    goods, note = F.col("STT").rlike(r"^\d+$"), (F.col("STT") == "") & ~amounts
    described = (F.col("THHDVu") != "") & ~F.col("THHDVu").rlike(r"^\(?\d+\)?$")
    whole = F.when(F.col("raw").isNotNull(), compact(rejoined(F.get("raw", F.try_element_at("columns", F.lit("THHDVu")))))).otherwise(F.col("THHDVu"))  # only a cell of several lines is rejoined
    columns = [*[whole.alias(f) if f == "THHDVu" else F.col(f) for f in FIELDS], F.when(goods, "1").when(note, "4").otherwise("").alias("TChat"), (~goods & ~note).alias("unclear")]
    return described & (goods | note | amounts), columns


def by_document(rows: DataFrame, *more: Column) -> DataFrame:
    """doc_id, lines, the totals and the rate rows of all tables of a document (``rows``: doc_id, table_no, row_idx, cells): rows are analysed once and shuffled once, by document.

    A line has table_no, row_idx, the item fields, TChat, unclear and the columns ``more`` (of a row of ``analysed``; nothing that can't be ordered). Lines stand in order; of totals the last statement
    counts; each rate row is there once. A document whose rows state nothing has no lines.
    """
    seen = analysed(rows, "doc_id", "table_no").withColumn("_may", F.expr(MAY_BE_LINE))
    seen = seen.select("doc_id", F.struct("table_no", "row_idx").alias("_at"), "raw", "columns", "_may", *TOTALS, "rate", F.struct(F.lit(0).alias("_"), *more).alias("_more"), *cells_by_field())
    is_line, line = _line()
    made = seen.select("doc_id", "_at", *TOTALS, "rate", F.when(F.col("_may") & is_line, F.struct("_at.*", *line, "_more.*")).alias("_line"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at")))
    rates = F.transform(F.array_sort(F.collect_list(F.when(F.col("rate").isNotNull(), F.struct("_at", "rate")))), lambda x: x["rate"])
    return made.groupBy("doc_id").agg(F.array_sort(F.collect_list("_line")).alias("lines"), *[last(c).alias(c) for c in TOTALS], F.array_distinct(rates).alias("rates"))


def _provenance(given: list[str]) -> list[Column]:
    method = F.coalesce("method", F.lit("PDF table")) if "method" in given else F.lit("PDF table")
    sure = F.map_from_entries(F.filter(F.transform(F.map_entries("columns"), lambda e: F.struct(e["key"].alias("key"), F.get("confidence", e["value"]).alias("value"))), lambda e: e["value"].isNotNull()))
    source = F.struct(
        F.col("page").cast("int").alias("page"), method.alias("method"), (sure if "confidence" in given else F.lit(None)).cast("map<string,double>").alias("confidence"),
        (F.col("bbox") if "bbox" in given else F.lit(None)).cast("array<double>").alias("bbox"),
    )
    said = F.concat(F.lit("Trang "), F.col("page").cast("string"), F.lit(" ("), method, F.lit(")"))
    return [source.alias("ExtractionSource"), F.array(F.struct(F.lit("Nguồn trích xuất").alias("TTruong"), F.lit("string").alias("KDLieu"), said.alias("DLieu"))).alias("TTKhac")]


def totals(tables: DataFrame) -> DataFrame:
    """table_id, the totals that its rows state (the last statement of each counts) and the different rate rows in order."""
    rows = analysed(tables)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("row_idx")))
    rates = F.transform(F.array_sort(F.collect_list(F.when(F.col("rate").isNotNull(), F.struct("row_idx", "rate")))), lambda x: x["rate"])
    return rows.groupBy("table_id").agg(*[last(c).alias(c) for c in TOTALS], F.array_distinct(rates).alias("rates"))


def markdown_cells(line: Column) -> Column:
    """The cells of a Markdown row: outer pipes off, split at unescaped pipes, marks gone and character references resolved."""
    inner = F.regexp_replace(F.regexp_replace(line, r"^\s+|\s+$", ""), r"^\|+|\|+$", "")

    def tidy(cell: Column) -> Column:
        steps = ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</?(?:b|strong|i|em)>", ""), (r"(?<!\\)[*_]{1,3}", ""))
        text = F.replace(reduce(lambda x, s: F.regexp_replace(x, *s), steps, cell), F.lit(r"\|"), F.lit("|"))
        return F.regexp_replace(html_unescaped(text), r"(?U)^\s+|\s+$", "")

    return F.transform(F.split(inner, r"(?<!\\)\|", -1), tidy)


def markdown_tables(pages: DataFrame) -> DataFrame:
    """page_id, table_no, row_idx, cells of the tables in ``pages`` (page_id, text): a row of at least two cells over a separator row of as many; the body goes on while rows have
    as many cells. Window functions over a page's lines."""
    lines = pages.select("page_id", F.posexplode(F.split(F.col("text"), LINE_END)).alias("no", "line"))
    lines = lines.withColumn("cells", F.when(F.contains("line", F.lit("|")), markdown_cells(F.col("line")))).withColumn("n", F.coalesce(F.size("cells"), F.lit(0)))
    lines = lines.withColumn("rule", F.coalesce(F.forall("cells", lambda c: F.rlike(F.replace(c, F.lit(" "), F.lit("")), F.lit("^:?-{3,}:?$"))), F.lit(False)))
    by_line = W.partitionBy("page_id").orderBy("no")
    upto = by_line.rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("head", (F.col("n") >= 2) & F.coalesce(F.lead("rule").over(by_line) & (F.lead("n").over(by_line) == F.col("n")), F.lit(False)))
    # a head begins a table only outside of one: a row of other width, or without cells, ends the table before it
    lines = lines.withColumn("run", F.sum(F.when((F.col("n") < 2) | (F.coalesce(F.lag("n").over(by_line), F.lit(0)) != F.col("n")), 1).otherwise(0)).over(upto))
    in_run = W.partitionBy("page_id", "run")
    lines = lines.withColumn("at", F.min(F.when(F.col("head"), F.col("no"))).over(in_run)).filter(F.col("at").isNotNull() & (F.col("no") >= F.col("at")) & (F.col("no") != F.col("at") + 1))
    number = F.dense_rank().over(W.partitionBy("page_id").orderBy("at")) - 1
    return lines.select("page_id", number.alias("table_no"), (F.row_number().over(W.partitionBy("page_id", "at").orderBy("no")) - 1).alias("row_idx"), "cells")


def appended_once(existing: Column, entry: Column) -> Column:
    """The array with the entry added unless it is there."""
    return F.when(F.array_contains(existing, entry), existing).otherwise(F.array_append(existing, entry))


def bearing_headers(tables: DataFrame) -> DataFrame:
    """Only the rows of tables that hold a header row somewhere."""
    has = tables.filter(header_columns(F.col("cells")).isNotNull()).select("table_id").distinct()
    return tables.join(has, "table_id", "left_semi")

