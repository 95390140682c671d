"""Scalar functions, Column in and Column out, that stay in the JVM."""

from __future__ import annotations

import mimetypes
import unicodedata
import zlib
from collections.abc import Callable
from functools import cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
#: What stands between cells where they are looked at as one text.
BETWEEN = "\x7f"
#: Cells, as one such text, that ``compact`` leaves as they are: Latin letters and signs without marks, with single spaces between them. Most are; telling so is much cheaper than looking for blanks in each.
TIDY = r"^(?:[!-\x7f]++|(?<=[^\x7f ]) (?=[^\x7f ])|[¡-˿Ḁ-ỿ]++)*+\z"
#: Line ends as Python's str.splitlines() sees them.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(c: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(col(c), F.lit(""))


def is_json(c: Column | str) -> Column:
    """Whether a text is one JSON value and nothing else; null for null. Spark's parser stops behind the first value. Here it meets the text within a list and within a group: what could follow a value in both is a comma, and then a value in
    one and a named value in the other, which no text is."""
    within = lambda a, z: F.try_parse_json(F.concat(F.lit(a), col(c), F.lit(z))).isNotNull()
    return F.when(col(c).isNotNull(), within("[", "]") & within('{"x":', "}"))


#: What the numbers 128 to 159 stand for in references: the signs of Windows-1252, which Spark doesn't decode.
OLD = "".join(bytes([x]).decode("cp1252", "ignore") or chr(x) for x in range(0x80, 0xA0))
#: In how many groups the names of character references are dealt by a hash.
NAMES = 1024


@cache
def _references() -> tuple[str, str]:
    """The pattern of a character reference, and the named ones, as HTML lists them; some are also known without their semicolon. Names are dealt into groups, so that one is looked up among two or three, not among all; they are
    one text, as a plan of thousands of literals takes longer than the work."""
    groups = [""] * NAMES
    for name, sign in sorted(html5.items()):
        groups[zlib.crc32(name.encode()) % NAMES] += f"\x01{name}\x02{sign}\x03"
    bare = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    return rf"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{bare}))", "\x04".join(groups)


def html_unescaped(c: Column | str) -> Column:
    """All HTML character references resolved; a text without one costs one look."""
    pattern, named = _references()

    def resolved(ref: Column) -> Column:
        code = F.when(F.rlike(ref, F.lit("^&#[xX]")), F.conv(F.regexp_extract(ref, "[xX]0*([0-9A-Fa-f]{1,8})(?![0-9A-Fa-f])", 1), 16, 10)).when(F.startswith(ref, F.lit("&#")), F.regexp_extract(ref, "[0-9]+", 0)).try_cast("bigint")
        legal = lambda code: F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), code).otherwise(0xFFFD)
        old = lambda code: F.substring(F.lit(OLD), (code - 0x7F).cast("int"), F.lit(1))
        sign = lambda code: F.when(code.between(0x80, 0x9F), old(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(F.startswith(ref, F.lit("&#")), let(let(code, legal), sign)).otherwise(let(F.substring(ref, F.lit(2), F.length(ref)), lambda name: F.coalesce(by_name(name), ref)))

    def by_name(name: Column) -> Column:
        group = F.get(F.split(F.lit(named), "\x04", -1), F.pmod(F.crc32(name.cast("binary")), F.lit(NAMES)).cast("int"))
        key = F.concat(F.lit("\x01"), name, F.lit("\x02"))
        return let(group, lambda x: F.when(F.contains(x, key), F.substring_index(F.call_function("substring_index", x, key, F.lit(-1)), "\x03", 1)))

    def joined(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))  # once a text, not once for each of its references
        pieces = lambda refs: F.transform(F.split(text, pattern, -1), lambda x, i: F.concat(x, F.coalesce(resolved(F.get(refs, i)), F.lit(""))))
        return F.array_join(let(found, pieces), "")

    return F.when(F.contains(col(c), F.lit("&")), joined(col(c))).otherwise(col(c))


def spaced(c: Column | str) -> Column:
    """Runs of white space to one space, none at the ends, null to empty."""
    return F.trim(F.regexp_replace(blank(c), f"(?! ){BLANK}{BLANK}*| {BLANK}+", " "))  # a lone space may stay


def compact(c: Column | str) -> Column:
    """The same of the composed text."""
    return spaced(nfc(c))


@cache
def compositions() -> list[tuple[str, str, str]]:
    """(mark, letters, letters with the mark) of the Latin letters that Unicode composes."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(chr(x) for x in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))
    out = []
    for mark in map(chr, range(0x300, 0x370)):
        pairs = [(x, y) for x in letters if len(y := unicodedata.normalize("NFC", x + mark)) == 1]
        if pairs:
            out.append((mark, *map("".join, zip(*pairs))))
    return out


def nfc(c: Column | str) -> Column:
    """Latin letters followed by combining marks as composed letters (Unicode NFC, for which Spark has no function); other scripts stay as they are. A text without
    marks costs one look."""
    s = col(c)

    def step(base: Column, mark: Column) -> Column:
        joined = reduce(lambda x, entry: x.when(mark == entry[0], F.translate(base, *entry[1:])), compositions()[1:], F.when(mark == compositions()[0][0], F.translate(base, *compositions()[0][1:]))).otherwise(base)
        return let(joined, lambda x: F.when(x != base, x).otherwise(F.concat(base, mark)))

    def piece(x: Column) -> Column:
        return F.when(F.rlike(x, F.lit(r"^\P{M}\p{M}+$")), F.aggregate(F.split(F.substring(x, F.lit(2), F.length(x)), ""), F.substring(x, 1, 1), step)).otherwise(x)

    cut = r"(?=\P{M}\p{M})|(?<=\p{M})(?=\P{M})"
    return F.when(s.rlike(r"\p{M}"), F.array_join(F.transform(F.split(s, cut), piece), "")).otherwise(s)


@cache
def accent_folds() -> tuple[str, str]:
    """Composed Latin letters and the base letters they reduce to, by decomposition."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(code):
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


def fold_accents(c: Column | str) -> Column:
    """Latin letters without their accents; of composed text the length doesn't change."""
    return F.regexp_replace(F.translate(col(c), *accent_folds()), r"\p{Mn}+", "")


def decimal_strict(c: Column | str) -> Column:
    """A number as printed on an invoice, 1.234.567,50; anything else is null. For validation."""
    # each step names the one before it once: named twice, the text (and all that it is made of) would be worked out twice for each use of the number
    bare = F.get(F.regexp_extract_all(F.regexp_replace(col(c), BLANK, ""), F.lit(r"^[-+]?(\d+|\d{1,3}(\.\d{3})+)(,\d+)?$"), F.lit(0)), F.lit(0))
    return F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(38,8)")


def decimal_lenient(c: Column | str) -> Column:
    """A number however it is written, for storage: the last of two kinds of separators is the decimal one; a lone
    separator before three digits, or one that repeats, groups; other characters are dropped."""
    s = reduce(lambda x, drop: F.replace(x, F.lit(drop), F.lit("")), (" ", "₫", "VND"), blank(c))
    count = lambda sign: F.length(s) - F.length(F.replace(s, F.lit(sign), F.lit("")))
    tail = lambda sign: F.length(F.substring_index(s, sign, -1))
    last = lambda sign: F.length(s) - tail(sign)
    drop = lambda sign: F.replace(s, F.lit(sign), F.lit(""))
    commas, dots = count(","), count(".")
    groups = lambda n, sign: (n > 1) | ((n == 1) & (tail(sign) == 3))
    unified = (
        F.when((commas > 0) & (dots > 0), F.when(last(",") > last("."), F.translate(s, ",.", ".")).otherwise(drop(",")))
        .when(groups(commas, ","), drop(","))
        .when(commas == 1, F.translate(s, ",", "."))
        .when(groups(dots, "."), drop("."))
        .otherwise(s)
    )
    return F.nullif(F.regexp_replace(unified, r"[^0-9.\-]", ""), F.lit("")).try_cast("decimal(19,4)")


def date_any(c: Column | str) -> Column:
    """The first ten characters as yyyy-m-d, d/m/yyyy or d-m-yyyy, else null."""
    s = F.substring(F.trim(col(c)), 1, 10)
    of = lambda shape, pattern: F.when(s.rlike(shape), F.try_to_date(s, pattern))
    return F.coalesce(of(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), of(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), of(r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"))


def spoken_date(c: Column | str) -> Column:
    """"Ngày 5 tháng 3 năm 2024" (also bilingual) as an ISO date; an impossible one is empty, none is null."""
    shape = r"(?i)Ngay\s*(?:\(date\))?\s*(\d{1,2})\s*thang\s*(?:\(month\))?\s*(\d{1,2})\s*nam\s*(?:\(year\))?\s*(\d{4})"
    folded = fold_accents(c)
    day, month, year = (F.regexp_extract(folded, shape, i) for i in (1, 2, 3))
    return F.when(day != "", F.coalesce(F.date_format(F.try_to_date(F.concat_ws("/", day, month, year), "d/M/yyyy"), "yyyy-MM-dd"), F.lit("")))


def tax_code(c: Column | str) -> Column:
    """Ten digits with an optional branch of three at the start, else empty."""
    return F.regexp_extract(blank(c), r"^(\d{10}(?:-\d{3})?)\b", 1)


def authority_code(c: Column | str) -> Column:
    return F.regexp_extract(blank(c), r"^[A-Za-z0-9]+", 0)


def integer_or(c: Column | str, fallback: Column) -> Column:
    s = F.trim(blank(c))
    return F.coalesce(F.when(s.rlike(r"^[-+]?\d+$"), s.try_cast("int")), fallback)


def numeric_total(c: Column | str) -> Column:
    return blank(c).rlike(r"^[-+]?\d[\d.,]*$")


def percent(c: Column | str) -> Column:
    """The rate in a text such as "Thuế suất 8%", with its sign; null without one."""
    found = F.regexp_extract(blank(c), r"(\d+(?:,\d+)?)[ \t]*%", 1)
    return F.when(found != "", F.concat(found, F.lit("%")))


def is_percent(c: Column | str) -> Column:
    return blank(c).rlike(r"^\d+(,\d+)?%$")


def rejoined(c: Column | str) -> Column:
    """An identifier broken after a slash, in one piece again."""
    return F.regexp_replace(col(c), r"(?U)/[ \t]*\n[ \t]*(?=\w)", "/")


def account_and_bank(c: Column | str) -> tuple[Column, Column]:
    """"123 Ngân hàng X" as ("123", "X"); (the whole, null) without a bank. Works on offsets, as folding keeps lengths."""
    before = F.regexp_extract(fold_accents(c), r"(?is)^(.*?)\bNgan hang\b[ :]*", 1)
    upto = F.regexp_extract(fold_accents(c), r"(?is)^.*?\bNgan hang\b[ :]*", 0)
    has = upto != ""
    bank = F.regexp_replace(F.substring(col(c), F.length(upto) + 1, F.length(col(c))), r"^[ |_]+|[ |_]+$", "")
    return F.when(has, F.trim(F.substring(col(c), F.lit(1), F.length(before)))).otherwise(col(c)), F.when(has, bank)


def local_name(c: Column | str) -> Column:
    return F.substring_index(col(c), "}", -1)


def markdown_to_text(c: Column | str) -> Column:
    """Markdown without its marks: images dropped, links to their text, headings and emphasis unmarked."""
    steps = ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"(?<!\\)[*_]{1,3}", ""))
    text = reduce(lambda x, s: F.regexp_replace(x, *s), steps, blank(c))
    return F.regexp_replace(F.replace(text, F.lit(r"\|"), F.lit("|")), f"^{BLANK}+|{BLANK}+$", "")


def readable_pages(c: Column | str) -> Column:
    """Pages (by form feeds) tidied: line ends unified, blanks collapsed, at most one empty line in a row, joined by a rule."""
    def tidy(page: Column) -> Column:
        lines = F.transform(F.split(page, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
        return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")

    return F.array_join(F.transform(F.split(F.regexp_replace(blank(c), r"\r\n?", "\n"), "\f"), tidy), "\n\n────────\n\n")


def usable_text(text: Column | str, picture_share: Column | None = None) -> Column:
    """Whether a page's text layer can be used: enough characters and words, few replacement characters, not a picture with a caption."""
    s = F.trim(blank(text))
    words = F.size(F.filter(F.split(s, f"{BLANK}+"), lambda w: w != ""))
    broken = F.length(s) - F.length(F.replace(s, F.lit("�"), F.lit("")))
    share = F.lit(0.0) if picture_share is None else F.coalesce(picture_share, F.lit(0.0))
    return (F.length(s) >= 40) & (broken / F.greatest(F.lit(1), F.length(s)) <= 0.01) & (words >= 10) & ~((share > 0.65) & (words < 80))


def ascii_lower(c: Column | str) -> Column:
    return F.translate(col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_ascii(c: Column | str, query: str) -> Column:
    """``LIKE '%query%'`` with ASCII case folded on both sides; % and _ in the query are wildcards, nothing is escaped."""
    folded = query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.like(ascii_lower(c), F.lit(f"%{folded}%"), F.lit("\x01"))


def stored_json(c: Column | str) -> Column:
    """A struct, map, list or variant as the JSON text that is stored: nulls kept, a space after each comma and colon that isn't part of a string. So a search for ``"STT": "1"`` finds it."""
    text = F.to_json(col(c), {"ignoreNullFields": "false"})
    return F.regexp_replace(text, r'\G((?:[^",:]++|"(?:[^"\\]++|\\.)*+")*+)([,:])', "$1$2 ")


def within(a: Column, b: Column, tolerance: int = 1) -> Column:
    """Amounts that differ by no more than the tolerance; exactly the tolerance passes."""
    return F.abs(a - b) <= tolerance


# File suffixes and media types of the readers.
IMAGES = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]


@cache
def guessed_suffixes() -> dict[str, list[str]]:
    """File suffixes by the media type that Python's registry guesses from them: of images, of text, and of the readers' own types."""
    out: dict[str, list[str]] = {"image": [], "text": [], "xml": [], "json": [], "pdf": []}
    own = {"application/xml": "xml", "text/xml": "xml", "application/json": "json", "application/pdf": "pdf"}
    for suffix, media in sorted(mimetypes.MimeTypes(filenames=()).types_map[True].items()):
        kind = own.get(media) or media.split("/")[0]
        if kind in out:
            out[kind].append(suffix)
    return out


def reader(path: Column | str, media: Column | str | None = None, use_ocr: Column | bool = False) -> Column:
    """Which reader takes a file: xml, json, pdf, image, text, or unknown (image if OCR is asked for). Suffix or media type decides, in that order of readers; without a media type, the one
    guessed from the name."""
    suffix = F.lower(F.regexp_extract(col(path), r"(\.[^./\\]+)$", 1))
    kind = F.coalesce(col(media), F.lit("")) if media is not None else F.lit("")
    ocr = F.lit(use_ocr) if isinstance(use_ocr, bool) else use_ocr
    guess = lambda name: (kind == "") & suffix.isin(*guessed_suffixes()[name])
    return (
        F.when((suffix == ".xml") | kind.isin("application/xml", "text/xml") | guess("xml"), "xml")
        .when((suffix == ".json") | (kind == "application/json") | guess("json"), "json")
        .when((suffix == ".pdf") | (kind == "application/pdf") | guess("pdf"), "pdf")
        .when(kind.startswith("image/") | suffix.isin(*IMAGES) | guess("image"), "image")
        .when(suffix.isin(".txt", ".csv") | kind.startswith("text/") | guess("text"), "text")
        .when(ocr, "image")
        .otherwise("unknown")
    )


def engine_used(ocr_used: Column, engine: Column) -> Column:
    return F.when(ocr_used, engine)


ENGINES = ("tesseract", "mistral")


def checked_engine(name: str) -> str:
    if name not in ENGINES:
        raise ValueError(f"unknown OCR engine {name!r}; known: {', '.join(ENGINES)}")
    return name
