import heapq
import zlib
from collections import defaultdict

from ledgerlark.llm import sharding


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, source string, slot int, size string")


def check(out, data, n):
    assert len(out) == len(data)
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return shards


def test_law_places_and_digests(spark):
    data = [(i, f"text {i} " + "x" * (i % 50), "s", 1, "clash") for i in range(2000)]
    out = sharding.shard_documents(rows(spark, data), 8).collect()
    shards = check(out, data, 8)
    loads = [sum(r.size for r in own) for own in shards.values()]
    assert len(loads) == 8 and max(loads) - min(loads) <= 80
    for r in out:
        text = data[r.doc_id][1]
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())


def test_copies_share_a_shard_unless_the_group_is_hot(spark):
    data = [(i, f"one {i // 3}", "s", 1, "") for i in range(600)]
    out = sharding.shard_documents(rows(spark, data), 4).collect()
    homes = defaultdict(set)
    for r in out:
        homes[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in homes.values())
    hot = data + [(i, "the same text again", "s", 1, "") for i in range(600, 1500)]
    shards = check(sharding.shard_documents(rows(spark, hot), 4).collect(), hot, 4)
    loads = [sum(r.size for r in own) for own in shards.values()]
    assert max(loads) - min(loads) <= 80


def test_nulls_repeats_and_empty(spark):
    data = [(None, None, None, None, None), (None, "", "s", 1, ""), (5, "ä" * 100_000, "s", 1, ""), (5, "ä" * 100_000, "s", 1, ""), (6, None, "s", 1, "")]
    shards = check(sharding.shard_documents(rows(spark, data), 40).collect(), data, 40)
    assert sorted(r.size for own in shards.values() for r in own) == [16, 16, 16, 200_016, 200_016]
    assert sharding.shard_documents(rows(spark, []), 40).count() == 0


def test_map_versions_and_rebalancing(spark, tmp_path):
    sums = {s: (100 + s % 7, 1) for s in range(512)}
    first = sharding.first_map(sums, 4, 512)
    grown = sharding.rebalanced(first, sums, 5)
    moved = [(a, b) for a, b in zip(first, grown) if a != b]
    assert moved and all(b == 4 for _, b in moved)
    loads = defaultdict(int)
    for s, (size, _) in sums.items():
        loads[grown[s]] += size
    assert len(loads) == 5 and max(loads.values()) - min(loads.values()) <= 2 * 107
    path = str(tmp_path / "map")
    sharding.save_map(spark, first, path, 1)
    sharding.save_map(spark, grown, path, 2)
    assert sharding.load_map(spark, path, 1) == first and sharding.load_map(spark, path, 2) == grown


def brute(data, n, slots=sharding.SLOTS):
    """doc_id, text, shard by plain Python: slots by hash, the heaviest slot first to the lightest shard."""
    import xxhash

    size = lambda t: len((t or "").encode()) + 16
    slot = {t: xxhash.xxh64_intdigest(t.encode(), seed=42) for t in {d[1] for d in data}}
    slot = {t: (h - 2**64 if h >= 2**63 else h) % slots for t, h in slot.items()}
    sums = defaultdict(int)
    for d in data:
        sums[slot[d[1]]] += size(d[1])
    load, placed = [(0, k) for k in range(n)], {}
    for s in sorted(sums, key=lambda s: (-sums[s], s)):
        least, k = heapq.heappop(load)
        placed[s] = k
        heapq.heappush(load, (least + sums[s], k))
    return sorted((d[0], placed[slot[d[1]]]) for d in data)


def test_against_brute_force(spark):
    data = [(i, f"t{i * 37 % 500} " + "ü" * (i * 13 % 400), "s", 1, "") for i in range(1500)]
    assert sorted((r.doc_id, r.shard) for r in sharding.shard_documents(rows(spark, data), 12).collect()) == brute(data, 12)


def test_a_stored_map_is_kept_and_edited(spark, tmp_path):
    path = str(tmp_path / "slots")
    data = [(i, f"text {i}", "s", 1, "") for i in range(3000)]
    placed = lambda data, n: {r.doc_id: r.shard for r in sharding.shard_documents(rows(spark, data), n, path=path).collect()}
    first = placed(data, 8)
    more = placed(data + [(i, f"text {i} and more", "s", 1, "") for i in range(3000, 4000)], 8)
    assert all(more[i] == first[i] for i in first) and sharding.latest_version(spark, path) == 1
    grown = placed(data, 9)
    moved = [i for i in first if grown[i] != first[i]]
    assert moved and all(grown[i] == 8 for i in moved) and sharding.latest_version(spark, path) == 2
    assert sharding.load_map(spark, path, 1) != sharding.load_map(spark, path, 2) and placed(data, 9) == grown
    hot = [(i, "the same", "s", 1, "") for i in range(5000, 9000)]
    check(sharding.shard_documents(rows(spark, data + hot), 9, path=path).collect(), data + hot, 9)
    assert sharding.latest_version(spark, path) == 3 and len(sharding.load_hot(spark, path, 3)) == 1 and placed(data, 9) == grown


def test_one_repeated_row_is_a_third_of_all(spark):
    data = [(i, f"text {i}", "s", 1, "") for i in range(600)] + [(7, "again", "s", 1, "")] * 300
    shards = check(sharding.shard_documents(rows(spark, data), 5).collect(), data, 5)
    assert sum(len(x) for x in shards.values()) == 900


def test_fewer_shards_move_only_what_must(spark, tmp_path):
    path = str(tmp_path / "slots")
    data = [(i, f"text {i}", "s", 1, "") for i in range(2000)]
    run = lambda n: sharding.shard_documents(rows(spark, data), n, path=path).collect()
    first = {r.doc_id: r.shard for r in run(10)}
    out = run(5)
    loads = [sum(r.size for r in own) for own in check(out, data, 5).values()]
    assert all(r.shard == first[r.doc_id] for r in out if first[r.doc_id] < 5) and len(loads) == 5 and max(loads) - min(loads) <= 80
    assert sharding.latest_version(spark, path) == 2


def test_a_grown_corpus_is_levelled(spark, tmp_path):
    path = str(tmp_path / "slots")
    data = [(i, f"text {i}", "s", 1, "") for i in range(1000)]
    first = {r.doc_id: r.shard for r in sharding.shard_documents(rows(spark, data), 6, path=path).collect()}
    more = data + [(i, f"text {i} " + "x" * 500, "s", 1, "") for i in range(1000, 4000) if i % 3 == 0 or sharding_home(i) < 2000]
    out = sharding.shard_documents(rows(spark, more), 6, path=path).collect()
    loads = [sum(r.size for r in own) for own in check(out, more, 6).values()]
    assert max(loads) <= sum(loads) / 6 * (1 + sharding.BAND) and first


def sharding_home(i):
    import xxhash

    h = xxhash.xxh64_intdigest((f"text {i} " + "x" * 500).encode(), seed=42)
    return (h - 2**64 if h >= 2**63 else h) % sharding.SLOTS


def test_levelled_moves_little_and_ends():
    placed = [s % 4 for s in range(64)]
    even = {s: (10, 1) for s in range(64)}
    assert sharding.levelled(placed, even, 4) is placed
    uneven = {s: (100 if s % 4 == 0 else 10, 1) for s in range(64)}
    out = sharding.levelled(placed, uneven, 4)
    load = [sum(uneven[s][0] for s in range(64) if out[s] == k) for k in range(4)]
    assert max(load) <= 1.2 * sum(load) / 4 and max(load) - min(load) < 2 * 100 and sum(a != b for a, b in zip(placed, out)) <= 16
    assert sharding.levelled(placed, {0: (10**6, 1), 4: (5, 1), 1: (5, 1)}, 4)[0] == 0
    assert sharding.levelled(placed, {}, 4) is placed


def test_a_lost_writer_leaves_nothing_that_is_read(spark, tmp_path):
    path = tmp_path / "slots"
    data = [(i, f"text {i}", "s", 1, "") for i in range(200)]
    sharding.shard_documents(rows(spark, data), 4, path=str(path)).collect()
    (path / "version=2" / "_temporary" / "0").mkdir(parents=True)
    assert sharding.latest_version(spark, str(path)) == 1
    check(sharding.shard_documents(rows(spark, data), 5, path=str(path)).collect(), data, 5)
    assert sharding.latest_version(spark, str(path)) == 2 and max(sharding.load_map(spark, str(path), 2)) == 4
