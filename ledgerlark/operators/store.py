"""Relational shredding, search, and a versioned store of documents.

The store is an append-only log: every write is a row with a higher version, a deletion is a row with ``deleted``. Readers take the latest version of
each id; children are recomputed from the document, never changed in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.scalars import blank, date_any, decimal_lenient, integer_or, is_json, let, like_ascii, stored_json

# Where the promoted fields stand in the document.
CORE = {
    "invoice_number": "TTChung.SHDon", "series": "TTChung.KHHDon", "form_number": "TTChung.KHMSHDon", "issue_date": "TTChung.NLap", "currency": "TTChung.DVTTe",
    "payment_method": "TTChung.HTTToan", "seller_name": "NDHDon.NBan.Ten", "seller_tax_code": "NDHDon.NBan.MST", "buyer_name": "NDHDon.NMua.Ten", "buyer_tax_code": "NDHDon.NMua.MST",
    "subtotal": "NDHDon.TToan.TgTCThue", "tax_total": "NDHDon.TToan.TgTThue", "grand_total": "NDHDon.TToan.TgTTTBSo", "tax_authority_code": "MCCQT",
}
NULLED = ("issue_date", "subtotal", "tax_total", "grand_total")
#: Columns of a stored invoice that a list shows.
LISTED = "invoice_id source_filename source_type ocr_enabled invoice_number series issue_date currency seller_name seller_tax_code buyer_name buyer_tax_code grand_total status created_at updated_at".split()
#: Columns that a search looks at.
SEARCHED = ("invoice_number", "seller_name", "seller_tax_code", "buyer_name", "buyer_tax_code", "tax_authority_code", "document_json")


def _core(typed: bool) -> list[Column]:
    out = []
    for name, path in CORE.items():
        value = F.col(f"document.{path}")
        plain = F.nullif(value, F.lit("")) if name in NULLED else blank(value)
        out.append(date_any(plain) if typed and name == "issue_date" else decimal_lenient(plain) if typed and name in NULLED else plain)
    return out


def typed_core() -> list[Column]:
    """The promoted fields of the column ``document``, as stored."""
    return [c.alias(n) for n, c in zip(CORE, _core(True))]


def core_fields(documents: DataFrame, typed: bool = False) -> DataFrame:
    """invoice_id and the 14 promoted fields; empty ones are '', the date and the amounts null. ``typed``: dates and decimals as stored."""
    return documents.select("invoice_id", *[c.alias(n) for n, c in zip(CORE, _core(typed))])


def line_json(x: Column, kind: T.StructType) -> Column:
    """``stored_json`` of a line. Most lines hold texts without anything to be escaped, an empty list and a null: those are put together, the others go through the JSON writer and a look at each of its signs."""
    texts = [f.name for f in kind if isinstance(f.dataType, T.StringType)]
    lists = [f.name for f in kind if isinstance(f.dataType, T.ArrayType)]
    others = [f.name for f in kind if f.name not in (*texts, *lists)]
    bare = reduce(lambda a, b: a & b, [F.coalesce(F.size(x[n]) == 0, F.lit(False)) for n in lists] + [x[n].isNull() for n in others], x.isNotNull())
    bare &= ~F.rlike(F.concat_ws("", *[x[n] for n in texts]), F.lit(r'["\\\x00-\x1f\x7f]'))
    said = lambda n: F.coalesce(F.concat(F.lit('"'), x[n], F.lit('"')), F.lit("null")) if n in texts else F.lit("[]" if n in lists else "null")
    parts = [part for i, f in enumerate(kind) for part in (F.lit(("{" if i == 0 else ", ") + f'"{f.name}": '), said(f.name))]
    return F.when(bare, F.concat(*parts, F.lit("}"))).otherwise(stored_json(x))


def shredded_items(documents: DataFrame) -> DataFrame:
    """One row per line of each document, typed; the line number falls back to the position."""
    x = F.col("item")
    rows = documents.select("invoice_id", F.posexplode("document.NDHDon.DSHHDVu").alias("at", "item"))
    return rows.select(
        "invoice_id", integer_or(x["STT"], F.col("at") + 1).alias("line_number"), x["MHHDVu"].alias("item_code"), x["THHDVu"].alias("description"), x["DVTinh"].alias("unit"),
        decimal_lenient(x["SLuong"]).alias("quantity"), decimal_lenient(x["DGia"]).alias("unit_price"), decimal_lenient(x["TLCKhau"]).cast("decimal(9,4)").alias("discount_rate"),
        decimal_lenient(x["STCKhau"]).alias("discount_amount"), decimal_lenient(x["ThTien"]).alias("amount"), x["TSuat"].alias("tax_rate"), decimal_lenient(x["TThue"]).alias("tax_amount"),
        line_json(x, rows.schema["item"].dataType).alias("item_json"),
    )


VARIANT_MAP, VARIANT_LIST = "map<string,variant>", "array<variant>"
#: Levels of the deepest document that can be parsed.
DEEPEST = 999


def _said(value: Column, falsy: bool = True) -> Column:
    """A JSON value as the text that is stored of it: true as True, groups as JSON. ``falsy``: null, false, zero and empty groups as the empty string, else null alone as null."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    group = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    written = F.when(kind == "BOOLEAN", F.initcap(text)).when(group, F.to_json(value)).otherwise(text)
    if not falsy:
        return F.when(kind == "STRING", text).otherwise(written)
    nothing = F.when(kind == "STRING", F.lit(False)).when(group, written.isin("{}", "[]")).when(kind == "BOOLEAN", text == "false").otherwise(F.coalesce(F.try_variant_get(value, "$", "double") == 0, F.lit(False)))
    return F.when(kind == "STRING", text).when(nothing, "").otherwise(F.coalesce(written, F.lit("")))  # most are strings: nothing else is looked at


ENTRIES = "array<struct<group_path:string,field_name:string,data_type:string,field_value:string>>"
NODES = "array<struct<path:string,named:map<string,variant>,listed:array<variant>>>"


def _node(path: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), F.try_variant_get(value, "$", VARIANT_MAP).alias("named"), F.try_variant_get(value, "$", VARIANT_LIST).alias("listed"))


def _groups(nodes: Column) -> Column:
    return F.filter(nodes, lambda x: x["named"].isNotNull() | x["listed"].isNotNull())


def _descended(state: Column) -> Column:
    """One level down from the open groups: their entries of extra groups are found, the groups within them are open next, unless no list that holds anything is ``left``."""
    field = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")

    def entries(node: Column) -> Column:
        path = F.when(node["path"] == "", "HDon").otherwise(node["path"])
        rows = F.filter(F.try_variant_get(F.try_element_at(node["named"], F.lit("TTKhac")), "$", VARIANT_LIST), lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
        return F.coalesce(F.transform(rows, lambda x: F.struct(path.alias("group_path"), _said(field(x, "TTruong"), False).alias("field_name"), _said(field(x, "KDLieu"), False).alias("data_type"), _said(field(x, "DLieu")).alias("field_value"))), F.array().cast(ENTRIES))

    def members(node: Column) -> Column:
        dot = F.when(node["path"] == "", "").otherwise(F.concat(node["path"], F.lit(".")))
        named = F.transform(F.map_entries(node["named"]), lambda e: _node(F.concat(dot, e["key"]), e["value"]))
        listed = F.transform(node["listed"], lambda e, i: _node(F.concat(node["path"], F.lit("["), i.cast("string"), F.lit("]")), e))
        return _groups(F.coalesce(named, listed, F.array().cast(NODES)))

    def opened(x: Column) -> Column:
        further = F.when(x["left"] > 0, F.flatten(F.transform(x["open"], members))).otherwise(F.array().cast(NODES))
        return F.struct(further.alias("open"), x["left"].alias("left"), F.concat(x["found"], F.flatten(F.transform(x["open"], entries))).alias("found"))

    holds = lambda node: F.coalesce(F.size(F.try_variant_get(F.try_element_at(node["named"], F.lit("TTKhac")), "$", VARIANT_LIST)) > 0, F.lit(False))
    left = state["left"] - F.size(F.filter(state["open"], holds))
    return F.when(F.size(state["open"]) == 0, state).otherwise(let(F.struct(state["open"].alias("open"), left.alias("left"), state["found"].alias("found")), opened))


def extra_entries(document_json: Column) -> Column:
    """group_path, field_name, data_type, field_value of every entry of a TTKhac list, at any depth, as an array; null for what can't be parsed. The levels are walked in the JVM, as many as the text has brackets at
    most, and no deeper than where the last list stands of as many that hold anything as the text can have; a document without one isn't walked."""
    none = F.array().cast(ENTRIES)
    brackets = F.octet_length(document_json) - F.octet_length(F.replace(F.replace(document_json, F.lit("["), F.lit("")), F.lit("{"), F.lit("")))  # bytes are known, characters would be counted
    lists = F.when(F.contains(document_json, F.lit("\\u")), 1 << 30).otherwise(F.regexp_count(document_json, F.lit(r'"TTKhac"\s*:\s*\[\s*[^\]\s]')))

    def walked(x: Column) -> Column:
        start = F.struct(_groups(F.array(_node(F.lit(""), x["value"]))).alias("open"), x["lists"].alias("left"), none.alias("found"))
        return F.aggregate(F.sequence(F.lit(1), F.when(x["most"].between(1, DEEPEST), x["most"]).otherwise(F.when(x["most"] < 1, 1).otherwise(DEEPEST))), start, lambda state, _: _descended(state), lambda state: state["found"])

    # each place that names a text's parse parses it again: the walk names it once
    read = lambda n: F.when(n > 0, let(F.struct(F.try_parse_json(document_json).alias("value"), n.alias("lists"), brackets.alias("most")), walked)).otherwise(none)
    return F.when(is_json(document_json), let(lists, read))


def shredded_extras(documents: DataFrame) -> DataFrame:
    """invoice_id, group_path, field_name, data_type, field_value from ``documents`` (invoice_id, document_json), within the rows' tasks and without Python. A document that can't be read, has a key twice or is nested deeper than ``DEEPEST`` has no entries;
    ``unreadable`` names it."""
    return documents.select("invoice_id", F.inline(extra_entries(F.col("document_json"))))


def unreadable(documents: DataFrame) -> DataFrame:
    """invoice_id, error of ``documents`` (invoice_id, document_json) whose JSON can't be read."""
    return documents.filter(~is_json("document_json")).select("invoice_id", F.lit("document_json is not valid JSON").alias("error"))


def created(drafts: DataFrame, now: Column) -> DataFrame:
    """Stored invoices of ``drafts`` (filename, content_type, ocr_enabled, extracted_text, document, document_json, source_base64): a new id, the promoted fields, the decoded source and both timestamps.
    Drafts with a column ``invoice_id`` keep theirs. A new id is another one each time that the rows are computed, so they must be written before anything is derived from them, as ``saved.Save`` does. A draft whose source isn't strict base64 is refused: its row has an ``error`` and nothing else but the file's name."""
    strict = F.coalesce("source_base64", F.lit("")).rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    rows = (drafts if "invoice_id" in drafts.columns else drafts.withColumn("invoice_id", F.uuid())).withColumn("_ok", strict)
    core = [F.when(F.col("_ok"), c).alias(n) for n, c in zip(CORE, _core(True))]
    kept = lambda c, name: F.when(F.col("_ok"), c).alias(name)
    return rows.select(
        kept(F.col("invoice_id"), "invoice_id"), F.coalesce(F.nullif("filename", F.lit("")), F.lit("invoice")).alias("source_filename"), kept(F.col("content_type"), "source_type"),
        kept(F.coalesce("ocr_enabled", F.lit(False)), "ocr_enabled"), kept(F.col("extracted_text"), "ocr_text"), *core, kept(F.col("document"), "document"), kept(F.col("document_json"), "document_json"),
        F.when(F.col("_ok"), F.try_to_binary(F.coalesce("source_base64", F.lit("")), F.lit("base64"))).alias("source_data"), kept(F.lit("draft"), "status"), kept(now, "created_at"), kept(now, "updated_at"),
        F.when(~F.col("_ok"), F.lit("the source is not valid base64")).alias("error"),
    )


def listed(invoices: DataFrame) -> DataFrame:
    """The columns of stored invoices that a list shows: neither text nor document nor source is read."""
    return invoices.select(*LISTED)


def search(invoices: DataFrame, query: str, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Rows in which any of the columns contains the query; an empty query keeps all."""
    if not query:
        return invoices
    return invoices.filter(F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(like_ascii(c, query), F.lit(False)) for c in columns]), F.lit(False)))


def page(invoices: DataFrame, number: int | str = 1, size: int | str = 25, order: str = "created_at", key: str = "invoice_id") -> DataFrame:
    """A page of the newest first, ties by key; bad numbers fall back to the first page and 25 rows, at most 100."""
    def whole(value: int | str, usual: int) -> int:
        try:
            return int(value)
        except (TypeError, ValueError):
            return usual

    n, rows = max(1, whole(number, 1)), min(100, max(1, whole(size, 25)))
    return invoices.orderBy(F.col(order).desc(), key).offset((n - 1) * rows).limit(rows)


def client_sort(invoices: DataFrame, column: str, descending: bool = False, numeric: bool = False, key: str = "invoice_id") -> DataFrame:
    """Rows by a column as a table view sorts them: null as '', amounts as text unless ``numeric``."""
    by = F.col(column) if numeric else F.coalesce(F.col(column).cast("string"), F.lit(""))
    return invoices.orderBy(by.desc() if descending else by.asc(), key)


def latest(log: DataFrame, key: str = "invoice_id") -> DataFrame:
    """The latest version of each id that isn't deleted: a maximum per key, taken before the shuffle as well. Of rows with one version a deletion counts, then the first by a hash of the columns
    (maps, which have none, left out)."""
    others = [c for c in log.columns if c not in (key, "version")]
    hashed = [f.name for f in log.schema if f.name in others and "map<" not in f.dataType.simpleString()]
    last = log.groupBy(key).agg(F.max_by(F.struct("version", *others), F.struct("version", F.coalesce("deleted", F.lit(False)), F.xxhash64(*hashed))).alias("x"))
    return last.select(key, "x.*").filter(~F.col("deleted"))


def updated(log: DataFrame, changes: DataFrame, kept: tuple[str, ...] = ("source_filename", "created_at"), key: str = "invoice_id", now: Column | None = None) -> DataFrame:
    """The log with a new version of each changed id that exists; the ``kept`` columns stay as they were, and ``updated_at``, where the log has it, becomes ``now``. ``missing`` names the ids that don't exist."""
    current = latest(log, key).alias("old")
    fresh = current.join(changes.alias("new"), key)
    own = {c: F.col(f"old.{c}") if c in kept or c not in changes.columns else F.col(f"new.{c}") for c in current.columns if c not in (key, "version")}
    if now is not None and "updated_at" in own:
        own["updated_at"] = now
    return log.unionByName(fresh.select(key, (F.col("old.version") + 1).alias("version"), *[v.alias(k) for k, v in own.items()]).select(log.columns))


def missing(log: DataFrame, changes: DataFrame, key: str = "invoice_id") -> DataFrame:
    """The ids in ``changes`` that aren't stored, or were deleted."""
    return changes.select(key).distinct().join(latest(log, key).select(key), key, "left_anti")


def deleted(log: DataFrame, ids: DataFrame, key: str = "invoice_id") -> DataFrame:
    """The log with a tombstone for each of the ids that exists."""
    gone = latest(log, key).join(ids.select(key).distinct(), key, "left_semi")
    return log.unionByName(gone.withColumns({"version": F.col("version") + 1, "deleted": F.lit(True)}).select(log.columns))


def orphans_removed(children: DataFrame, parents: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Children whose parent is still there: what ON DELETE CASCADE leaves."""
    return children.join(parents.select(key), key, "left_semi")


def without_row(rows: Column, index: int) -> Column:
    return F.filter(rows, lambda _, i: i != index)


def with_row(rows: Column, row: Column) -> Column:
    """The array with a row appended whose STT is one more than their number."""
    return F.array_append(rows, row.withField("STT", (F.size(rows) + 1).cast("string")))


def with_value(document: Column, path: str, value: Column) -> Column:
    """The struct with the field at a dotted path replaced."""
    return document.withField(path, value)


def with_item_value(rows: Column, index: int, field: str, value: Column) -> Column:
    return F.transform(rows, lambda x, i: F.when(i == index, x.withField(field, value)).otherwise(x))
