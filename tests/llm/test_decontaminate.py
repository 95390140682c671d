import random

import numpy as np
import pytest

from ledgerlark.llm import decontaminate as D


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, item_id string, answer string")


def items(spark, data):
    return spark.createDataFrame(data, "item_id long, text string, doc_id int")


def made(seed=1, n=160):
    rng = random.Random(seed)
    pool = [f"{a}{b}" for a in "ba ke li mo nu ra se ti vo zu".split() for b in "ba ke li mo nu ra se ti vo zu dor fin".split()]
    common = "the of and to in is it on as at".split()
    sentence = lambda k: [rng.choice(common) if rng.random() < 0.4 else rng.choice(pool) + rng.choice(pool) for _ in range(k)]
    bench = [(i, " ".join(sentence(rng.randint(16, 59))) + ".", 0) for i in range(25)]
    docs, want = [], set()
    for i in range(n):
        own = sentence(rng.randint(20, 400))
        kind = i % 4
        if kind < 2:
            item, text, _ = bench[rng.randrange(25)]
            words = text.split()
            if kind == 1:
                for k in rng.sample(range(len(words)), len(words) // 8):
                    words[k] = rng.choice(pool) + "x"
            at = rng.randint(0, len(own))
            own[at:at] = words
            want.add((i, item))
        docs.append((i, " ".join(own), "x", "y"))
    return docs, bench, want


def test_planted_passages_are_found_and_others_left(spark):
    docs, bench, want = made()
    got = {(r.doc_id, r.item_id) for r in D.leaks(rows(spark, docs), items(spark, bench)).collect()}
    assert got == want
    kept = D.clean(rows(spark, docs), items(spark, bench))
    assert kept.columns == ["doc_id", "text", "item_id", "answer"] and {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {i for i, _ in want}


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    docs, bench, want = made(2, 60)
    monkeypatch.setattr(D, "QUERIES", 8)
    assert {(r.doc_id, r.item_id) for r in D.leaks(rows(spark, docs), items(spark, bench)).collect()} == want


def test_latent_space_equals_brute_force(spark):
    docs, bench, _ = made(3, 40)
    idf, windows = D.measured(rows(spark, docs))
    asked = D.asked(items(spark, bench))
    vectors = D.passage_vectors(rows(spark, docs), asked, idf, windows)
    found = [(np.frombuffer(r.at, "<i4"), np.frombuffer(r.w, "<f4")) for r in vectors.collect()]
    assert len(found) == windows + len(bench) and windows == sum(-(-len(t.split()) // D.WINDOW) for _, t, *_ in docs)
    dense = np.zeros((len(found), D.FEATURES))
    for i, (at, w) in enumerate(found):
        dense[i, at] = w
    table = np.random.default_rng(1).standard_normal((D.FEATURES, 7))
    assert np.allclose(D.product(vectors, table), dense.T @ (dense @ table), atol=1e-3)
    space = D.latent_space(vectors, dims=60)
    left, values, right = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(space.T @ space, np.eye(60), atol=1e-4)
    assert np.linalg.norm(dense @ space) ** 2 >= 0.9 * (values[:60] ** 2).sum()
    block = D.block(asked.select("key", "text", "answer"), idf, space)
    for p, own in zip(block.found, block.latent):
        at, w = D.vector(p.words, idf)
        projected = w @ space[at]
        assert np.allclose(own, projected / np.linalg.norm(projected), atol=1e-4)


@pytest.mark.parametrize("n", [40, 400, 1000, 5000])
def test_result_equals_an_exhaustive_check(spark, n):
    rng = random.Random(n)
    pool = [f"{a}{b}" for a in "ba ke li mo nu ra se ti vo zu".split() for b in "ba ke li mo nu ra se ti vo zu dor fin".split()]
    word = lambda: rng.choice("the of and to in is".split()) if rng.random() < 0.3 else rng.choice(pool) + rng.choice(pool)
    bench = [(i, " ".join(word() for _ in range((6, 8, 12, 36)[i % 4])), 0) for i in range(n)]
    docs = []
    for i in range(48):
        own = [word() for _ in range(150)]
        for k in range(2):
            text = bench[rng.randrange(n)][1].split()
            for at in rng.sample(range(len(text)), rng.choice((0, 0, len(text) // 6, len(text) // 3))):
                text[at] = word() + "x"
            own[k * 70 + 5 : k * 70 + 5] = text
        docs.append((i, " ".join(own), "x", "y"))
    want = set()
    found = D.passages([(i, t, None) for i, t, _ in bench])
    for i, text, *_ in docs:
        own = D._text_words(text)
        want |= {(i, p.item_id) for p in found if D.best_share(own, p.words, p.answer)[0]}
    assert len(want) > 60
    assert {(r.doc_id, r.item_id) for r in D.leaks(rows(spark, docs), items(spark, bench)).collect()} == want


def test_weights_are_document_frequencies(spark):
    docs = [(i, "aa bb aa " + ("cc" if i < 10 else ""), "x", "y") for i in range(40)]
    idf = D.weights(rows(spark, docs))
    for w, n in (("aa", 40), ("cc", 10), ("dd", 0)):
        assert idf[int(D._text_words(w)[0] >> D.SHIFT)] == round(16 * np.log(41 / (n + 1)))


def test_edges(spark):
    docs, bench, _ = made(4, 8)
    leak = bench[0][1]
    odd = [(None, None, None, None), (None, leak, None, None), (50, "", "x", "y"), (51, leak.upper(), "x", "y"), (51, leak.upper(), "x", "y"), (52, "w " * 60_000 + leak, "x", "y"), (53, "a b c", "x", "y")]
    found = [(r.doc_id, r.item_id) for r in D.leaks(rows(spark, odd), items(spark, bench + [(90, None, 0), (91, "", 0), (92, "a b c", 0), (0, leak, 0)])).collect()]
    assert sorted(found, key=repr) == sorted([(None, 0), (51, 0), (51, 0), (52, 0)], key=repr)
    assert D.leaks(rows(spark, []), items(spark, bench)).count() == 0 and D.leaks(rows(spark, odd), items(spark, [])).count() == 0
    assert D.clean(rows(spark, odd), items(spark, [])).count() == 7


@pytest.mark.parametrize(("a", "b", "n"), [("abcd", "abcd", 4), ("axbycz", "abc", 3), ("cba", "abc", 1), ("", "abc", 0), ("aabb", "ab", 2)])
def test_lcs(a, b, n):
    code = lambda s: np.array([ord(c) for c in s], dtype=np.uint64)
    assert D.lcs(code(a), code(b)) == n


def test_answer_decides_paraphrases():
    words = [f"w{i}" for i in range(20)]
    passage = D.passages([(1, " ".join(words[:15]) + ". " + " ".join(words[15:]), None)])[0]
    assert len(passage.answer) == 5 and D.passages([(1, "one two three four five six", "six")])[0].answer.shape == (1,)
    assert [len(p.words) for p in D.passages([(1, " ".join(f"x{i}" for i in range(150)), None)])] == [64, 64, 64, 54]


def test_copies_are_found_among_many_items(spark):
    rng = random.Random(5)
    pool = [f"{a}{b}" for a in "ba ke li mo nu ra se ti vo zu".split() for b in "ba ke li mo nu ra se ti vo zu dor fin".split()]
    sentence = lambda k: " ".join(rng.choice(pool) + rng.choice(pool) for _ in range(k))
    bench = [(i, sentence(rng.randint(16, 59)), 0) for i in range(1100)]
    docs = [(i, f"{sentence(60)} {text} {sentence(60)}", "x", "y") for i, text, _ in bench]
    assert {(r.doc_id, r.item_id) for r in D.leaks(rows(spark, docs), items(spark, bench)).collect()} == {(i, i) for i in range(1100)}


def test_copies_that_most_documents_hold_are_found(spark):
    rng = random.Random(6)
    pool = [f"{a}{b}" for a in "ba ke li mo nu ra se ti vo zu".split() for b in "ba ke li mo nu ra se ti vo zu dor fin".split()]
    sentence = lambda k: " ".join(rng.choice(pool) + rng.choice(pool) for _ in range(k))
    bench = [(i, sentence(rng.randint(15, 44)), 0) for i in range(8)]
    docs, want = [], set()
    for i in range(120):
        held = [x for x in bench if rng.random() < 0.6]
        docs.append((i, " ".join([sentence(60)] + [f"{text} {sentence(60)}" for _, text, _ in held]), "x", "y"))
        want |= {(i, item) for item, _, _ in held}
    assert {(r.doc_id, r.item_id) for r in D.leaks(rows(spark, docs), items(spark, bench)).collect()} == want
    one = D.leaks(rows(spark, docs[:1]), items(spark, bench)).collect()
    assert {r.item_id for r in one} == {item for doc, item in want if doc == 0}


def test_every_paraphrase_that_the_check_takes_is_found(spark):
    rng = random.Random(7)
    pool = [f"{a}{b}" for a in "ba ke li mo nu ra se ti vo zu".split() for b in "ba ke li mo nu ra se ti vo zu dor fin".split()]
    other = lambda k: [rng.choice(pool) + rng.choice(pool) + "x" for _ in range(k)]
    bench = [(i, f"{' '.join(other(rng.randint(8, 40)))}. {' '.join(other(rng.randint(4, 6)))}.", 0) for i in range(60)]
    docs, want = [], set()
    for i, text, _ in bench:
        words, answer = text[:-1].split(". ")
        words, answer = words.split(), answer.split()
        for k, share in enumerate((0.5, 0.55, 0.6, 0.7, 0.8)):
            lost = min(len(words), int((1 - share) * (len(words) + len(answer))))
            own = list(words)
            for at in rng.sample(range(len(words)), lost):
                own[at] = "".join(other(1)) + "y"
            docs.append((10 * i + k, " ".join(other(60) + own + answer + other(60)), "x", "y"))
            want.add((10 * i + k, i))
    assert {(r.doc_id, r.item_id) for r in D.leaks(rows(spark, docs), items(spark, bench)).collect()} == want


def test_items_of_few_words_are_found_word_for_word(spark):
    docs = [(1, "x y one two three four z", "x", "y"), (2, "one two z three four", "x", "y"), (3, "four three two one", "x", "y"), (4, "one Two, three four. Five", "x", "y"), (5, "one two three", "x", "y")]
    got = {(r.doc_id, r.item_id, r.word) for r in D.leaks(rows(spark, docs), items(spark, [(1, "One two three four.", 0), (2, "one two three four five", 0)])).collect()}
    assert got == {(1, 1, 2), (4, 1, 0), (4, 2, 0)}


def test_a_window_without_the_answer_does_not_hide_one_with_it():
    passage, other = np.arange(1, 21, dtype=np.uint64), np.arange(100, 140, dtype=np.uint64)
    assert D.best_share(np.concatenate((passage[:10], other, passage[10:])), passage, passage[15:]) == (0.5, 1.0, 50)


def test_candidates_without_enough_different_words_are_settled_by_lookups(monkeypatch):
    """Most candidates are a passage's frequent words again and again: no array is searched and no subsequence looked for. Shares stay those of the definition."""
    passage, other = np.arange(1, 25, dtype=np.uint64), np.arange(100, 200, dtype=np.uint64)
    calls = []
    whole = D._subsequence
    monkeypatch.setattr(D, "_subsequence", lambda places, n: calls.append(n) or whole(places, n))
    monkeypatch.setattr(D.np, "isin", lambda *a: calls.append(a))
    assert D.best_share(np.tile(passage[:11], 20), passage, passage[20:]) == (0.0, 0.0, 0) and not calls
    assert D.best_share(np.concatenate((other, passage, other)), passage, passage[20:], D._masks(passage)) == (1.0, 1.0, 100) and set(calls) == {24, 4}


def test_the_space_is_fitted_on_every_window(spark):
    """However many there are; the fit goes through all of them without writing them."""
    docs = spark.range(40_000).selectExpr("id as doc_id", "concat_ws(' ', 'a', concat('w', id), concat('x', id % 97)) as text")
    idf, windows = D.measured(docs)
    asked = D.asked(items(spark, [(1, "w1 w2 x3 x4 a b", 0)]))
    assert windows == 40_000 and D.passage_vectors(docs, asked, idf, windows).count() == 40_001
    few, bench, _ = made(8, 30)
    few, bench = rows(spark, few).repartition(3), D.asked(items(spark, bench))
    idf = D.weights(few)
    found = [(np.frombuffer(r.at, "<i4"), np.frombuffer(r.w, "<f4")) for r in D.passage_vectors(few, bench, idf).collect()]
    dense = np.zeros((len(found), D.FEATURES))
    for i, (at, w) in enumerate(found):
        dense[i, at] = w
    own = [D.vector(D._text_words(t)[i : i + D.WINDOW], idf) for (t,) in few.select("text").collect() for i in range(0, len(D._text_words(t)), D.WINDOW)]
    assert all((a == b).all() and np.allclose(v, w, atol=1e-6) for (a, v), (b, w) in zip(sorted(own, key=lambda x: x[0].tolist()), sorted(found[: len(own)], key=lambda x: x[0].tolist())))
    table = np.random.default_rng(2).standard_normal((D.FEATURES, 5))
    windows = dense[: len(own)]
    assert np.allclose(D.text_product(few, table, idf), windows.T @ (windows @ table), atol=1e-3)
    space = D.fitted_space(few, bench, idf)
    kept = np.linalg.norm(space, axis=0) > 0.5
    assert np.allclose(space[:, kept].T @ space[:, kept], np.eye(kept.sum()), atol=1e-3)
    start = np.linalg.qr(D.latent_space(D.asked_vectors(bench, idf), dims=D.DIMS + D.OVER))[0][:, : D.DIMS]
    assert kept.all() and np.linalg.norm(dense @ space) > np.linalg.norm(dense @ start)
