"""What the table and form views compute, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import IMAGES, blank, col


def contains_any(query: str, *columns: Column | str) -> Column:
    """Whether any of the columns contains the query, whatever the case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(blank(c)), F.lit(query.lower())) for c in columns])


def all_empty(*columns: Column | str) -> Column:
    """A document none of whose fields was read: not an invoice."""
    return F.forall(F.array(*[blank(c) for c in columns]), lambda x: x == "")


def valid_email(c: Column | str) -> Column:
    return blank(c).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def long_enough(c: Column | str, least: int) -> Column:
    """Names (3) and passwords (6) of at least so many characters; an empty one passes, as nothing was typed yet."""
    s = blank(c)
    return (s == "") | (F.length(s) >= least)


def confirmed(new: Column | str, again: Column | str) -> Column:
    return col(new).eqNullSafe(col(again))


def details_missing(key: Column | str, details: Column | str) -> Column:
    """A party that is named by its id but of which nothing is known."""
    return col(key).isNotNull() & (F.size(F.coalesce(col(details), F.create_map().cast("map<string,string>"))) == 0)


def overridden(record: Column | str, key: str, value: Column) -> Column:
    """The map with one key replaced where a value is given."""
    base = F.map_filter(col(record), lambda k, _: k != key)
    return F.when(value.isNotNull(), F.map_concat(base, F.create_map(F.lit(key), value))).otherwise(col(record))


def is_active(key: Column | str, active: str) -> Column:
    return col(key) == F.lit(active)


def tabs_for(tabs: Column | str, restricted: list[str], role_allows: bool) -> Column:
    """Tabs that a role may see."""
    return col(tabs) if role_allows else F.filter(col(tabs), lambda t: ~t.isin(*restricted))


def total_seconds(*parts: Column | str) -> Column:
    return F.round(reduce(lambda a, b: a + b, [col(p) for p in parts]), 2)


def preview(path: Column | str, media: Column | str) -> Column:
    """How a source can be shown: image, pdf, text or nothing."""
    suffix, kind = F.lower(F.regexp_extract(blank(path), r"(\.[^./\\]+)$", 1)), blank(media)
    return (
        F.when(kind.startswith("image/") | suffix.isin(*IMAGES), "image").when((kind == "application/pdf") | (suffix == ".pdf"), "pdf")
        .when(kind.startswith("text/") | kind.isin("application/json", "application/xml") | suffix.isin(".txt", ".csv", ".json", ".xml"), "text")
    )


def primitive_fields(df: DataFrame, record: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """The fields of a struct that hold plain values, all or the included ones, without the excluded."""
    simple = [f.name for f in df.schema[record].dataType if f.dataType.typeName() not in ("struct", "array", "map")]
    return df.select(*[F.col(f"{record}.{n}") for n in simple if (not include or n in include) and n not in exclude])


def languages(installed: Column | str, wanted: tuple[str, ...] = ("vie", "eng")) -> Column:
    """The wanted recognition languages that are installed, in order, joined by +; empty if none is."""
    return F.array_join(F.array_intersect(F.array(*map(F.lit, wanted)), col(installed)), "+")


def serialised(df: DataFrame) -> DataFrame:
    """Rows as they go over the wire: column names with a small first letter, dates in ISO form, decimals as text."""
    out = []
    for f in df.schema:
        kind, value = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind.startswith("decimal"):
            value = value.cast("string")
        elif kind == "date":
            value = F.date_format(value, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        out.append(value.alias(f.name[:1].lower() + f.name[1:]))
    return df.select(*out)
