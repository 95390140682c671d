import random
import re

import pytest

from ledgerlark.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOWN = str.maketrans(L.UPPER, L.LOWER)


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, label string, block string")


def words(text):
    return WORD.findall((text or "").translate(DOWN))


def brute(text):
    own = words(text)
    places, base = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(own)) if own[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    share, met = 0.0, set()
    lines = [x for x in (text or "").split("\n") if words(x)]
    for i in range(len(lines)):
        block = set(words("\n".join(lines[i : i + L.LINES])))
        for t, label in L.TEMPLATES.items():
            template = set(t.split())
            if len(template & block) >= L.THRESHOLD * len(template) - 1e-9:
                met.add(label)
                share = max(share, len(template & block) / len(template))
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | met)), 1.0 if base else share


def same(spark, data):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in L.scan(rows(spark, data)).collect()), key=repr)
    assert got == sorted(((d[0], *brute(d[1])) for d in data), key=repr)
    return got


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = sorted({w for t in L.TEMPLATES for w in t.split()}) + ["mit", "MIT", "Ärger", "x9", "und", "of"]
    data = []
    for i in range(400):
        lines = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.4:
                own = rng.choice([*L.TEMPLATES, *L.PHRASES]).split()
                if rng.random() < 0.6:
                    own = [w for w in own if rng.random() < 0.95] + rng.sample(pool, rng.randint(0, 3))
                if rng.random() < 0.3:
                    rng.shuffle(own)
                lines.append(rng.choice((" ", "  ", "-", ", ")).join(w.title() if rng.random() < 0.2 else w for w in own))
            else:
                lines.append(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))))
        data.append((i, "\n".join(lines), "c", "d"))
    got = same(spark, data)
    assert sum(1 for r in got if r[6]) > 100 and sum(1 for r in got if r[6] != r[5]) > 30


def test_edges(spark):
    long = "apache license, version 2 " * 30_000
    same(spark, [(None, None, None, None), (1, "", "", ""), (2, " \n--\n", "", ""), (3, long, "", ""), (4, "Released under the MIT License.", "", ""), (4, "Released under the MIT License.", "", ""), (4, "other", "", ""), (None, "cc by nc cc by nc", "", "")])
    assert L.scan(rows(spark, [])).count() == 0


def test_ties_threshold_and_prefix():
    known = L.ordered({"a b c d e f g h i j": "x"}, {"j": 0, "a": 5}, 0.8)
    assert known[0][1][-1] == "a" and known[0][2] == 8 and len(known[0][3]) == 3


def test_join_of_blocks(spark):
    templates = {"a b c d e": "five", "a b": "two"}
    known = L.ordered(templates, {}, 0.8)
    blocks = spark.createDataFrame([(1, " a b c d "), (2, " a b "), (3, " e c d b "), (4, " a c "), (5, "  ")], "row int, block string")
    got = sorted((r.row, r.label, r.overlap, r.share) for r in L.joined_blocks(blocks, known).collect())
    assert got == [(1, "five", 4, pytest.approx(0.8)), (1, "two", 2, 1.0), (2, "two", 2, 1.0), (3, "five", 4, pytest.approx(0.8))]


MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this"""


def test_wrapped_license_texts(spark):
    data = [(i, f"x y\n\n{t}\nmore", "", "") for i, t in enumerate((MIT, BSD, GPL, MPL))]
    assert [(r[6], r[7]) for r in same(spark, data)] == [("mit", 1.0), ("bsd", 1.0), ("gpl", 1.0), ("mpl-2", 1.0)]


def test_length_and_position_drop_rows(spark):
    templates = {"a b c d e f g h i j": "ten", "p q": "two"}
    df = {w: k for k, w in enumerate("p q a b c d e f g h i j".split())}
    known = L.ordered(templates, df, 0.8)
    data = [(1, " a b c d e f g h "), (2, " a b "), (3, " p q a b c d e f "), (4, " p q a b c d e f g h "), (5, " c d e f g h i j ")]
    probes = L.probed(spark.createDataFrame(data, "row int, block string"), known, df)
    long_enough = probes.filter("size(_tokens) >= _least")
    left = L.bounded(probes)
    key = lambda rows: {(r.row, r.label) for r in rows.collect()}
    assert (2, "ten") in key(probes) - key(long_enough)  # by length
    assert (3, "ten") in key(long_enough) - key(left)  # by position
    got = L.joined_blocks(spark.createDataFrame(data, "row int, block string"), known, df).collect()
    assert sorted((r.row, r.label, r.overlap) for r in got) == [(1, "ten", 8), (3, "two", 2), (4, "ten", 8), (4, "two", 2), (5, "ten", 8)]


def test_random_blocks_against_all_pairs(spark):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(30)]
    templates = {" ".join(rng.sample(pool, rng.randint(1, 14))): f"t{i}" for i in range(12)}
    df = {w: rng.randint(0, 9) for w in pool}
    known = L.ordered(templates, df, 0.7)
    data = [(i, f" {' '.join(rng.choice(pool) for _ in range(rng.randint(0, 25)))} ") for i in range(300)]
    got = sorted((r.row, r.label, r.overlap) for r in L.joined_blocks(spark.createDataFrame(data, "row int, block string"), known, df).collect())
    want = sorted((i, label, n) for i, b in data for t, label in templates.items() if (n := len(set(t.split()) & set(b.split()))) >= 0.7 * len(set(t.split())) - 1e-9)
    assert got == want and len(want) > 100
