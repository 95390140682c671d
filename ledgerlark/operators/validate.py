"""Arithmetic validation of invoices as one grouped pass over their lines.

``items``: invoice_id, pos and the string fields STT, SLuong, DGia, TLCKhau, STCKhau, ThTien, TThue, TChat as printed. ``totals``: invoice_id, TgTCThue,
TgTThue, TgTTTBSo as printed. Only lines with TChat 1 are checked; R8 counts all. Amounts differ if by more than one unit.

Lines are shuffled once, by invoice; the windows over line numbers and the grouping all use that partitioning. Lines that bear their invoice's totals need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import blank, decimal_strict, nfc
from ledgerlark.operators import labels

RULES = {
    "R1": "line number repeated",
    "R2": "quantity, price or amount missing or unreadable",
    "R3": "quantity times price less discount is not the amount",
    "R4": "line numbers are not 1 to n in order",
    "R5": "line amounts do not add up to the subtotal",
    "R6": "line taxes do not add up to the tax total",
    "R7": "subtotal and tax do not add up to the total",
    "R8": "there are lines but no readable total",
}
EXACT = "decimal(38,8)"
#: The amounts of a line whose confidence is looked at.
AMOUNTS = ("SLuong", "DGia", "ThTien", "TThue")


def _count(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0)).cast("long")


TOTALS = ("TgTCThue", "TgTThue", "TgTTTBSo")


def _judged(items: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """All lines with ``goods``, their parsed numbers and r1, r2, r3 and in_order, which count goods only."""
    number = blank("STT")
    goods, numeric = blank("TChat") == "1", number.rlike(r"^\d+$")
    by_pos = W.partitionBy("invoice_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy("invoice_id", goods, F.when(number == "", "?").otherwise(number)).orderBy("pos")
    quantity, price, amount, discount = (decimal_strict(c) for c in ("SLuong", "DGia", "ThTien", "STCKhau"))
    lines = items.select(
        "invoice_id", "pos", "STT", *kept, goods.alias("goods"), quantity.alias("quantity"), price.alias("price"), amount.alias("amount"), decimal_strict("TThue").alias("tax"),
        discount.alias("discount"), blank("STCKhau").alias("stated"), (blank("TLCKhau") != "").alias("by_rate"),
        F.sum(F.when(goods & numeric, 1).otherwise(0)).over(by_pos).alias("nth"), numeric.alias("numeric"), F.row_number().over(same).alias("repeat"),
    )
    known = F.col("quantity").isNotNull() & F.col("price").isNotNull() & F.col("amount").isNotNull()
    due = (F.col("quantity") * F.col("price")).cast(EXACT) - F.coalesce("discount", F.lit(0).cast(EXACT)) - F.col("amount")
    return lines.select(
        "invoice_id", "pos", "STT", *kept, "goods", "amount", "tax",
        (F.col("repeat") > 1).alias("r1"),
        (~known).alias("r2"),
        F.coalesce(known & ~F.col("by_rate") & ((F.col("stated") == "") | F.col("discount").isNotNull()) & (F.abs(due) > 1), F.lit(False)).alias("r3"),
        F.when(F.col("numeric"), F.col("STT").try_cast("bigint").eqNullSafe(F.col("nth"))).alias("in_order"),
    )


def line_findings(items: DataFrame) -> DataFrame:
    """The goods lines with their amounts and taxes and r1, r2, r3 and in_order."""
    return _judged(items).filter("goods").drop("goods")


def line_arithmetic(items: DataFrame) -> DataFrame:
    """The goods lines that r2 or r3 speaks against: invoice_id, pos, r2, r3. They are unpacked from a list of none or one, as a filter would be moved below the numbers and parse them anew for each of its tests."""
    found = F.when(F.col("r2") | F.col("r3"), F.array(F.struct("pos", "r2", "r3")))
    return line_findings(items).select("invoice_id", F.explode(found).alias("x")).select("invoice_id", "x.*")


def rule_counts(items: DataFrame, totals: DataFrame | None = None, kept: tuple[str, ...] = (), extra: tuple[Column, ...] = ()) -> DataFrame:
    """invoice_id and r1 to r8: how often each rule speaks for each invoice. Without ``totals``, the lines bear those of their invoice, and all is one shuffle of the lines. ``extra``: further
    aggregates, by name, of the columns ``kept``, made in the same pass."""
    goods = F.col("goods")
    judged = _judged(items, kept if totals is not None else (*TOTALS, *kept))
    lines = judged.groupBy("invoice_id").agg(
        _count(goods).alias("n"), *[_count(goods & F.col(r)).alias(r) for r in ("r1", "r2", "r3")], F.bool_or(~goods).alias("notes"),
        F.bool_and(F.when(goods, F.col("in_order"))).alias("in_order"), F.count(F.when(goods, F.col("amount"))).alias("n_amount"), F.sum(F.when(goods, F.col("amount"))).alias("amounts"),
        F.count(F.when(goods, F.col("tax"))).alias("n_tax"), F.sum(F.when(goods, F.col("tax"))).alias("taxes"), *([] if totals is not None else [F.first(c).alias(c) for c in TOTALS]), *extra,
    )
    own = [c for c in lines.columns if c not in ("invoice_id", "n", "r1", "r2", "r3", "notes", "in_order", "n_amount", "amounts", "n_tax", "taxes", *TOTALS)]
    whole = lines if totals is None else totals.select("invoice_id", *TOTALS).join(lines, "invoice_id", "left")
    parsed = [decimal_strict(c).alias(name) for c, name in zip(TOTALS, ("subtotal", "tax_total", "total"))]
    all_ = whole.select(*[c for c in whole.columns if c not in TOTALS], *parsed)
    n = F.coalesce("n", F.lit(0))
    off = lambda x, y: F.coalesce(F.abs(x - y) > 1, F.lit(False)).cast("long")
    zero = F.lit(0).cast("long")
    return all_.select(
        "invoice_id", *(F.coalesce(r, zero).alias(r) for r in ("r1", "r2", "r3")),
        (~F.coalesce("in_order", F.lit(True))).cast("long").alias("r4"),
        F.when((n > 0) & (F.col("n_amount") == n), off(F.col("amounts"), F.col("subtotal"))).otherwise(zero).alias("r5"),
        F.when((n > 0) & (F.col("n_tax") == n), off(F.col("taxes"), F.col("tax_total"))).otherwise(zero).alias("r6"),
        off(F.col("subtotal") + F.col("tax_total"), F.col("total")).alias("r7"),
        (((n > 0) | F.coalesce("notes", F.lit(False))) & F.col("total").isNull()).cast("long").alias("r8"), *own,
    )


def findings(items: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """invoice_id, rule, times: what speaks against each invoice."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r.lower()).alias("times")) for r in RULES])
    return rule_counts(items, totals).select("invoice_id", F.explode(F.filter(pairs, lambda p: p["times"] > 0)).alias("f")).select("invoice_id", "f.rule", "f.times")


def summary(items: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """rule, findings, invoices."""
    return findings(items, totals).groupBy("rule").agg(F.sum("times").alias("findings"), F.count("*").alias("invoices"))


def read_checks(documents: DataFrame) -> DataFrame:
    """R9 (no lines but text) and R10 (no number or no date) of parsed documents: invoice_id, rule."""
    general, content = F.col("document.TTChung"), F.col("document.NDHDon")
    no_lines = (F.size(F.coalesce(content["DSHHDVu"], F.array())) == 0) & (F.trim(blank("extracted_text")) != "")
    unnamed = (blank(general["SHDon"]) == "") | (blank(general["NLap"]) == "")
    rules = F.array_compact(F.array(F.when(no_lines, "R9"), F.when(unnamed, "R10")))
    return documents.select("invoice_id", F.explode(rules).alias("rule"))


def low_confidence(items: DataFrame, least: int = 70) -> DataFrame:
    """R11: the amounts of each line that were read with less confidence than ``least`` (invoice_id, pos, fields)."""
    return items.select("invoice_id", "pos", weak_fields(F.col("confidence"), least).alias("fields")).filter(F.size("fields") > 0)


def weak_fields(confidence: Column, least: int = 70) -> Column:
    """The amounts of a line that are given and were read with less confidence than ``least``."""
    return F.array_compact(F.array(*[F.when((blank(f) != "") & (F.coalesce(F.try_element_at(confidence, F.lit(f)), F.lit(100.0)) < least), F.lit(f)) for f in AMOUNTS]))


def stated_rates(text: Column | str) -> Column:
    """The different percentages that a text's rate labels state; other values don't count."""
    own = F.filter(labels.label_pairs(nfc(blank(text))), lambda p: (p["label"] == "rate") & p["value"].rlike(r"^\d+(,\d+)?%$"))
    return F.array_distinct(F.transform(own, lambda p: p["value"]))


def single_rate(texts: DataFrame, totals: DataFrame) -> DataFrame:
    """Where an invoice's text (``texts``: invoice_id, text) states exactly one rate and no rate rows were read (``totals`` may count them in n_rates): invoice_id, TSuat, and ThTien and TThue of the one row that stands
    for all, null unless subtotal and tax are both known."""
    rates = texts.select("invoice_id", stated_rates("text").alias("rates")).filter(F.size("rates") == 1)
    open_ = totals.filter(F.coalesce("n_rates", F.lit(0)) == 0) if "n_rates" in totals.columns else totals
    known = (blank("TgTCThue") != "") & (blank("TgTThue") != "")
    return rates.join(open_.select("invoice_id", "TgTCThue", "TgTThue"), "invoice_id").select("invoice_id", F.get("rates", F.lit(0)).alias("TSuat"), F.when(known, F.col("TgTCThue")).alias("ThTien"), F.when(known, F.col("TgTThue")).alias("TThue"))


def with_single_rate(items: DataFrame, rates: DataFrame) -> DataFrame:
    """``items`` with the single rate (``rates``: invoice_id, TSuat) on goods lines that have none."""
    one = rates.select("invoice_id", F.col("TSuat").alias("_rate"))
    goods = (blank("TChat") == "1") & (blank("TSuat") == "")
    return items.join(one, "invoice_id", "left").withColumn("TSuat", F.when(goods, F.coalesce("_rate", "TSuat")).otherwise(F.col("TSuat"))).drop("_rate")


def single_item_tax(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Where the only goods line has no tax and its amount is the subtotal, it bears the whole tax: invoice_id, TThue."""
    goods = items.filter(blank("TChat") == "1").groupBy("invoice_id").agg(F.count("*").alias("n"), F.min("ThTien").alias("amount"), F.min(blank("TThue")).alias("tax"))
    same = decimal_strict("amount") == decimal_strict("TgTCThue")
    return goods.filter("n = 1 and tax = ''").join(totals, "invoice_id").filter(same & (blank("TgTThue") != "")).select("invoice_id", F.col("TgTThue").alias("TThue"))
