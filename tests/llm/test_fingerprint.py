import hashlib

import numpy as np

from ledgerlark.llm import fingerprint as fp


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, bucket int, guest string")


def brute(data):
    order = sorted(((i, t or "") for i, t, *_ in data), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + following[:half], following


def same(spark, data):
    got = sorted(fp.fingerprints(rows(spark, data)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.edited_sha256))
    want = sorted(brute(data), key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256(x[2].encode()).hexdigest()))
    assert len(got) == len(want)
    for r, (i, t, edited, following) in zip(got, want):
        assert r.doc_id == i and r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fp.fingerprint(t) and r.edited_fingerprint == fp.fingerprint(edited)
        assert r.near_edited == like(t, edited) and r.near_next == like(t, following)
    return got


def like(a, b):
    return float(fp.likeness(fp.vectors([a]), fp.vectors([b]))[0])


def text(i):
    return "\n".join(" ".join(f"w{(i * 31 + k * 7 + j) % 997}ü" for j in range(12)) for k in range(i % 9))


def test_against_brute_force(spark):
    got = same(spark, [(i * 3, text(i), 1, "x") for i in range(300)])
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.2


def test_nulls_repeats_long_and_empty(spark):
    same(spark, [(None, None, 1, "x"), (None, "b", 1, "x"), (4, "", 1, "x"), (4, "", 1, "x"), (4, "a\n\nb", 1, "x"), (2, "é ü " * 400_000, 1, "x"), (9, None, 1, "x")])
    same(spark, [(7, "only one here", 1, "x")])
    same(spark, [(None, None, 1, "x"), (None, None, 1, "x")])
    assert fp.fingerprints(rows(spark, [])).count() == 0


def test_order_insertion_and_deletion():
    a, b = "one two three four\nfive six\n\nseven", "seven\n\nfive six\none two three four"
    assert fp.fingerprint(a) == fp.fingerprint(b) != fp.fingerprint(a + "\nseven")
    assert fp.inserted(fp.fingerprint("one two three four"), ["seven", "", "five six"]) == fp.fingerprint(a)
    assert fp.deleted(fp.fingerprint(a), ["five six", ""]) == fp.fingerprint("seven\none two three four")
    assert fp.fingerprint(None) == fp.fingerprint("")


def test_likeness():
    words = [f"word{i}" for i in range(400)]
    full, half = " ".join(words), " ".join(words[:200] + [f"other{i}" for i in range(200)])
    assert like(full, full) == 1.0 and abs(like(full, half) - 0.5) < 0.2
    assert like(full, " ".join(f"x{i}" for i in range(400))) < 0.25 and like("", "") == 1.0 and like("", full) == 0.0


def test_likeness_of_very_repetitive_texts():
    assert like("w " * 40_000, "w " * 30_000) > 0.9 and like("w " * 20_000, "w " * 15_000) > 0.9 and like("w x " * 70_000, "y z " * 70_000) < 0.1
