"""License scans: phrases by place, and templates by an exact set-similarity join. DataFrame functions only.

A template is a set of words. A text block is a line with the ``LINES`` - 1 lines after it, lines without words left out, so that a wording wrapped over them is whole in one block; it meets
a template if it holds at least ``THRESHOLD`` of the template's words. The join is exact and prunes by

* order: the templates' words stand by ascending document frequency in the scanned corpus, ties by word, in templates and blocks alike (words of no
  template can't be held in common and don't count);
* prefix: a template of n words met at m = ceil(THRESHOLD * n) has one of its n - m + 1 rarest words in common with the block, and the block, of x such
  words, has one of its x - m + 1 rarest in common with the template: only these are joined;
* length: such a block has at least m words of templates;
* position: if the first word in common is the template's i-th and the block's j-th, counted from 0, at most min(n - i, x - j) words are held in common, which must not be below m.

The templates are a fixed table, so the side that is broadcast doesn't grow with the corpus; blocks are never joined to
blocks.

Nulls: a null text has no words. A null doc_id is kept. Repeated rows are scanned each. An empty table gives an empty result. Columns besides doc_id and
text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.shared import written

# The phrases that are counted by place, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wordings of common licenses, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}
THRESHOLD = 0.9
#: Lines of a block.
LINES = 3

#: Between words, when A-Z count as letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text in their own case, each between single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")), F.lit(" "))


def normal(text: Column) -> Column:
    """The same, lower-cased in ASCII."""
    return F.translate(spaced(text), UPPER, LOWER)


def word_count(words: Column) -> Column:
    """Of a text with its words between single spaces."""
    return F.when(words == "  ", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) - 1).cast("long")


def _starts(phrase: str) -> Column:
    """Word numbers at which the phrase starts in the array ``_words``; looked for only where the text contains it."""
    own = phrase.split()

    def here(i: Column) -> Column:
        ok = F.get(F.col("_words"), i) == own[0]
        for k, w in enumerate(own[1:], 1):
            ok = ok & (F.get(F.col("_words"), i + k) == w)
        return F.coalesce(ok, F.lit(False))

    return F.when(F.contains(F.col("_normal"), F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), F.size("_words") - 1), here)).otherwise(_no_places())


def _no_places() -> Column:
    return F.array().cast("array<int>")


def frequencies(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[str, int]:
    """How many documents hold each word of the templates: at most one row per such word reaches the driver."""
    words = sorted({w for t in templates for w in t.split()})
    held = F.array_intersect(F.split(F.lower(spaced(F.col("text"))), " "), F.array(*map(F.lit, words)))
    return {w: 0 for w in words} | {r["word"]: r["n"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


Known = list[tuple[str, list[str], int, list[str]]]


def ordered(templates: dict[str, str], df: dict[str, int], threshold: float = THRESHOLD) -> Known:
    """(label, words by ascending frequency, least overlap, prefix) of each template."""
    out = []
    for text, label in templates.items():
        words = sorted(set(text.split()), key=lambda w: (df.get(w, 0), w))
        least = math.ceil(threshold * len(words) - 1e-9)
        out.append((label, words, least, words[: len(words) - least + 1]))
    return out


def prefix_words(known: Known) -> list[str]:
    return sorted({w for _, _, _, prefix in known for w in prefix})


def probed(blocks: DataFrame, known: Known, df: dict[str, int]) -> DataFrame:
    """``blocks`` (column ``block``, in normal form) with each template (``label``, ``_template``, ``_least``) of which a prefix word is among their own prefix words: in the template's place ``_i`` and the block's
    ``_j``. ``_tokens``: the block's words of templates in the global order."""
    table = F.array(*[
        F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("_template"), F.lit(least).alias("_least"), F.lit(w).alias("_word"), F.lit(i).alias("_i"))
        for label, words, least, prefix in known for i, w in enumerate(prefix)
    ])
    templates = blocks.sparkSession.range(1).select(F.explode(table).alias("t")).select("t.*")
    vocabulary = sorted({w for _, words, _, _ in known for w in words}, key=lambda w: (df.get(w, 0), w))
    fewest = min(least for _, _, least, _ in known)
    tokens = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(F.trim("block"), " "))
    prefix = F.slice("_tokens", F.lit(1), F.greatest(F.lit(0), F.size("_tokens") - fewest + 1))
    return blocks.withColumn("_tokens", tokens).select("*", F.posexplode(prefix).alias("_j", "_word")).join(F.broadcast(templates), "_word")


def bounded(probes: DataFrame) -> DataFrame:
    """The probes that can meet their template by length and position."""
    x, n = F.size("_tokens"), F.size("_template")
    return probes.filter((x >= F.col("_least")) & (F.least(n - F.col("_i"), x - F.col("_j")) >= F.col("_least")))


def joined_blocks(blocks: DataFrame, known: Known, df: dict[str, int] | None = None) -> DataFrame:
    """The columns of ``blocks`` with label, overlap and share: one row for each block and each template that it meets."""
    return (
        bounded(probed(blocks, known, df or {}))
        .withColumn("_common", F.array_intersect("_template", "_tokens"))
        .filter(F.col("_word") == F.get("_common", F.lit(0)))  # once for each pair: at its first word in common
        .withColumn("overlap", F.size("_common"))
        .filter(F.col("overlap") >= F.col("_least"))
        .withColumn("share", F.col("overlap") / F.size("_template"))
        .select(*blocks.columns, "label", "overlap", "share")
    )


def blocks_of(text: Column, either: str) -> Column:
    """The blocks of a text in which a line matches ``either``."""
    def of(lines: Column) -> Column:
        telling = F.transform(lines, lambda line: F.rlike(line, F.lit(f"(?i)({either})")))
        block = lambda line, i: F.when(F.exists(F.slice(telling, i + 1, LINES), lambda x: x), F.array_join(F.slice(lines, i + 1, LINES), "\n"))
        return F.filter(F.transform(lines, block), lambda x: x.isNotNull())

    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(LETTER)))
    return F.get(F.transform(F.array(lines), of), F.lit(0))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per document.

    score: the largest containment of a template's words in a block that meets it; 1 where a phrase stands, 0 where nothing is found. Two
    passes over the texts: one for the frequencies, one that keeps what is counted and the blocks of documents that hold a
    prefix word.
    """
    df = frequencies(docs, templates)
    known = ordered(templates, df, threshold)
    either = "|".join(prefix_words(known))
    phrases = "|".join(PHRASES)
    base = (
        docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.coalesce("text", F.lit("")).alias("_text"))
        .withColumn("_spaced", spaced(F.col("_text")))
        .withColumn("_normal", F.when(F.rlike("_spaced", F.lit(f"(?i) ({phrases}) ")), F.translate("_spaced", UPPER, LOWER)))
        .withColumn("_words", F.split(F.trim("_normal"), " "))
        .withColumn("_places", F.coalesce(F.flatten(F.array(*[_starts(p) for p in PHRASES])), _no_places()))
        .withColumn("_base", F.array_compact(F.array(*[F.when(F.contains(F.col("_normal"), F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items()])))
        .select(
            "doc_id", "_hash", word_count(F.col("_spaced")).alias("n_words"), "_places", "_base",
            F.when(F.rlike("_spaced", F.lit(f"(?i) ({either}) ")), blocks_of(F.col("_text"), either)).alias("_lines"),
        )
    )
    base = written(base, "licenses")
    lines = base.filter("_lines is not null").select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), F.explode("_lines").alias("_line"))
    met = joined_blocks(lines.select("_id", "_h", normal(F.col("_line")).alias("block")), known, df)
    per = met.groupBy("_id", "_h").agg(F.collect_set("label").alias("_found"), F.max("share").alias("_share"))
    out = base.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id", "n_words", F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"), F.array_max("_places").cast("long").alias("last_word"),
        listed(F.col("_base")).alias("base_labels"),
        listed(F.concat("_base", F.coalesce("_found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
