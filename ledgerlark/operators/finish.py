"""Pages to finished invoices: texts and tables of a document become its fields, lines, totals, rates and warnings.

Everything meets by document: one aggregation of pages, one of the rows of tables (lines, totals and rates together), and one of lines, which finds what speaks against them. Pages and rows are each shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import blank, decimal_strict
from ledgerlark.operators import labels, tables, validate

PAGE_BREAK = "\n\f\n"
TOTALS = tables.TOTALS


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id, text of ``pages`` (doc_id, page, text): the pages in order."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", blank("text").alias("text")))), lambda x: x["text"]), PAGE_BREAK).alias("text"))


def first_filled(own: Column, other: Column) -> Column:
    """The first of two lists that isn't empty."""
    return F.when(F.size(own) > 0, own).otherwise(other)


def _other(lines: DataFrame, per: DataFrame) -> DataFrame:
    """doc_id and lines from elsewhere in the form and order of those of ``per``; what they lack is null."""
    of = per.schema["lines"].dataType.elementType
    line = F.struct(*[(F.col(f.name) if f.name in lines.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in of])
    return lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("_other"))


def finished(pages: DataFrame, rows: DataFrame, other_lines: DataFrame | None = None) -> DataFrame:
    """doc_id, number, issued, the three totals, rates, lines, warnings.

    ``pages``: doc_id, page, text. ``rows``: doc_id, table_no, row_idx, cells, and perhaps where they come from (page, method, confidence, bbox). Totals stated in tables override those found in the text; if the text's rate
    labels state one rate and no rate rows were read, it is the rate of the goods lines that have none, and of one rate row if subtotal and tax are known; the only goods line takes the whole tax if its amount is the
    subtotal; warnings are rule numbers, each once. ``other_lines`` (doc_id, and the columns of lines) are used for documents whose tables gave no line.
    """
    texts = labels.with_fields(joined_pages(pages))
    sourced = "page" in rows.columns
    sure = F.transform(F.array(*map(F.lit, validate.AMOUNTS)), lambda f: F.get("confidence", F.try_element_at("columns", f)))
    more = ([F.col("page").cast("int").alias("page")] if sourced else []) + ([sure.alias("sure")] if sourced and "confidence" in rows.columns else [])
    per = tables.by_document(rows, *more).select("doc_id", "lines", *[F.col(c).alias(f"t_{c}") for c in TOTALS], "rates")
    general = lambda name: labels.field("general", name)
    met = texts.join(per, "doc_id", "left")
    if other_lines is not None:
        met = met.join(_other(other_lines, per), "doc_id", "left").withColumn("lines", first_filled(F.coalesce("lines", F.array().cast(per.schema["lines"].dataType)), F.col("_other"))).drop("_other")
    totals = met.select(
        F.col("doc_id").alias("invoice_id"), "lines", (F.trim(blank("text")) != "").alias("_said"), general("SHDon").alias("number"), general("NLap").alias("issued"), validate.stated_rates("text").alias("_stated"),
        *[F.coalesce(f"t_{c}", labels.field("totals", c)).alias(c) for c in TOTALS], F.coalesce("rates", F.array().cast("array<struct<TSuat:string,ThTien:string,TThue:string>>")).alias("rates"),
    )
    totals = totals.withColumn("_rate", F.when((F.size("_stated") == 1) & (F.size("rates") == 0), F.get("_stated", F.lit(0)))).drop("_stated")

    # each document with its lines, or with none, where it lies
    met = totals.withColumn("_goods", F.size(F.filter("lines", lambda x: x["TChat"] == "1")))
    met = met.select("invoice_id", *TOTALS, "_goods", "_rate", F.struct("number", "issued", "_said", "_rate", "rates").alias("_doc"), F.posexplode_outer("lines").alias("pos", "_x"))
    met = met.select(*[c for c in met.columns if c not in ("pos", "_x")], (F.coalesce("pos", F.lit(0)) + 1).alias("pos"), "_x.*")
    goods = F.coalesce(F.col("TChat") == "1", F.lit(False))
    alone = goods & (F.col("_goods") == 1) & (blank("TThue") == "") & (blank("TgTThue") != "") & (decimal_strict("ThTien") == decimal_strict("TgTCThue"))
    met = met.withColumns({"TSuat": F.when(goods & (blank("TSuat") == ""), F.coalesce("_rate", "TSuat")).otherwise(F.col("TSuat")), "TThue": F.when(F.coalesce(alone, F.lit(False)), F.col("TgTThue")).otherwise(F.col("TThue"))})
    weak = F.size(validate.weak_fields(F.map_from_arrays(F.array(*map(F.lit, validate.AMOUNTS)), F.col("sure")))) > 0 if len(more) == 2 else F.lit(False)
    line = F.when(F.col("row_idx").isNotNull(), F.struct("pos", *tables.FIELDS, "TChat", *(["page"] if sourced else [])))
    met = met.withColumns({"_line": line, "_weak": weak, "_unclear": F.coalesce("unclear", F.lit(False))})
    counted = validate.rule_counts(met, None, ("_line", "_weak", "_unclear", "_doc"), (
        F.array_sort(F.collect_list("_line")).alias("lines"), F.bool_or("_weak").alias("_weak"), F.bool_or("_unclear").alias("_unclear"), F.first("_doc").alias("_doc"), *[F.first(c).alias(f"_{c}") for c in TOTALS],
    ))
    d, none = F.col("_doc"), F.size("lines") == 0
    rules = [F.when(F.col(r.lower()) > 0, r) for r in ("R1", "R2", "R3", "R4", "R5", "R6", "R7")] + [F.when((F.col("r8") > 0) & ~none, "R8")]
    rules += [F.when(none & d["_said"], "R9"), F.when(d["_said"] & ((blank(d["number"]) == "") | (blank(d["issued"]) == "")), "R10"), F.when(F.col("_weak"), "R11"), F.when(F.col("_unclear"), "R12")]
    known = (blank("_TgTCThue") != "") & (blank("_TgTThue") != "") & d["_rate"].isNotNull()
    row = F.array(F.struct(d["_rate"].alias("TSuat"), F.col("_TgTCThue").alias("ThTien"), F.col("_TgTThue").alias("TThue")))
    return counted.select(
        F.col("invoice_id").alias("doc_id"), d["number"].alias("number"), d["issued"].alias("issued"), *[F.col(f"_{c}").alias(c) for c in TOTALS], F.when(known, row).otherwise(d["rates"]).alias("rates"),
        F.when(~none, F.col("lines")).alias("lines"), F.array_sort(F.array_compact(F.array(*rules))).alias("warnings"),
    )
