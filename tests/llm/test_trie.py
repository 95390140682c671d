import hashlib
import random
import zlib
from collections import defaultdict

from ledgerlark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    inner = {k[:-1] for k in members if k}
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += k not in inner
        if k:
            children[k[:-1]] += 1
    out = []
    for k, m in members.items():
        ids = ",".join(str(c) for c in m if len(paths[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    got = sorted((tuple(r) for r in trie.prefix_trie(df).select(*columns).collect()), key=repr)
    assert got == brute(rows)
    return got


def made(seed, ids, longest, texts):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice(texts)) for c in ids for t in range(r.randint(1, longest))]


def test_against_brute_force(spark):
    rows = made(1, [*range(0, 60), *range(101, 130), *range(200, 240), 1000, 5005, -3, -100, -101, -250], 9, ["a", "bb", "ünï"])
    check(spark, rows)
    random.Random(2).shuffle(rows)
    check(spark, rows + rows[:40])


def test_conversations_much_longer_than_a_cycle(spark):
    rows = made(3, range(0, 12), 60, ["a", "b"]) + [(c, t, "user", "same") for c in (300, 301, 302, 303, 407, 408) for t in range(50 + c % 3)]
    got = check(spark, rows)
    assert max(r[1] for r in got) >= 50


def test_edges(spark):
    check(spark, [])
    check(spark, [(None, 1, "user", "x")])
    nobody = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)  # its base is missing and its own turns go
    assert check(spark, [(nobody, 0, "user", "x")]) == [(nobody, 0, None, 1, 0, 1, 0, hashlib.sha256(str(nobody).encode()).hexdigest())]
    check(spark, [(1, None, None, None), (1, 3, "user", None), (1, None, "user", "late" * 9000), (1, 3, "user", None), (0, 2, None, ""), (0, 2, "system", ""), (None, 1, "user", "x"), (2, 1, "", "userx"), (3, 1, "user", "x")])


def test_many_copies_end_at_one_node(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 1200) for t in range(3)]
    got = check(spark, rows)
    assert max(r[3] for r in got) == 1200
