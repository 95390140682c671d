"""Sharding over fixed virtual slots.

Every record is hashed into one of ``SLOTS`` slots that never change. The bytes of each slot are summed, and a small
versioned map, stored as Parquet, says which shard holds which slot; moving data means editing that map, never rehashing records. The first run over a path stores version 1, and
every run takes its shards from the latest version that is stored; for more shards it stores an edited version, in which slots move to the new shards only, for fewer shards one in which only the slots of those that go
move. Where the corpus has changed so much that a shard is more than ``BAND`` above its fair share, slots move from the fullest shards to the emptiest until it is even again. A version is one file that appears
when it is complete; what a writer left that was lost before that isn't read, and the next one replaces it. One writer at a time.
Everything that touches records is DataFrame functions; only the map (``SLOTS`` rows at any input size) is handled
on the driver.

Law: ``bytes``. Equal texts hash to the same slot and so share a shard, except a group of copies that alone exceeds
half a shard's fair share: its rows are dealt over all slots by ``doc_id``, so that no group overloads a shard. Which groups are, is stored with the map.

Nulls: a null text has no bytes and hashes as such; a null ``doc_id`` is kept. Repeated rows each get a place. An empty table gives
an empty result. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_right, insort

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.llm.shared import fresh_path

#: Virtual slots: fixed for the life of a corpus.
SLOTS = 8192
#: Bytes counted for a record besides its text.
OVERHEAD = 16
#: How far above its fair share a shard of a stored map may come before the map is edited, and how far it may be afterwards.
BAND, EVEN = 0.2, 0.01


def _element(values: list[int], index: Column) -> Column:
    """The value at a 0-based index of a constant array of at most SLOTS numbers."""
    return F.element_at(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), (index + 1).cast("int"))


def slim(docs: DataFrame) -> DataFrame:
    """A record without its text: doc_id, size, text_crc32 and the text's hash."""
    text = F.col("text")
    return docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )


def hot_groups(records: DataFrame, n_shards: int, slots: int = SLOTS) -> list[int]:
    """The text hashes of groups of copies that alone exceed half a shard's fair share: fewer than 2 * n_shards. Two bounded looks at the sums find them: the slots above half
    a fair share (fewer than 2 * n_shards), then the texts in them that are themselves above it."""
    plain = F.pmod(F.col("_text"), F.lit(slots))
    sums = {r["s"]: r["b"] for r in records.groupBy(plain.alias("s")).agg(F.sum("size").alias("b")).collect()}
    half = sum(sums.values()) / n_shards / 2
    heavy = [s for s, b in sums.items() if b > half]
    if not heavy:
        return []
    groups = records.filter(plain.isin(heavy)).groupBy("_text").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return sorted(r["_text"] for r in groups.filter((F.col("b") > half) & (F.col("n") > 1)).collect())


def slotted(records: DataFrame, hot: list[int], slots: int = SLOTS) -> DataFrame:
    """Adds ``virtual_slot``: by the text's hash, of hot groups also by doc_id."""
    plain = F.pmod(F.col("_text"), F.lit(slots))
    slot = F.when(F.col("_text").isin(hot), F.pmod(F.xxhash64("_text", "doc_id"), F.lit(slots))).otherwise(plain) if hot else plain
    return records.withColumn("virtual_slot", slot.cast("int"))


def slot_sums(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot in use; at most SLOTS entries."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["virtual_slot"]: (r["b"], r["n"]) for r in rows}


def first_map(sums: dict[int, tuple[int, int]], n_shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot: the heaviest slot first, each to the lightest shard so far; unused slots round-robin."""
    placed = [s % n_shards for s in range(slots)]
    load = [(0, shard) for shard in range(n_shards)]
    for slot, (size, _) in sorted(sums.items(), key=lambda x: (-x[1][0], x[0])):
        least, shard = heapq.heappop(load)
        placed[slot] = shard
        heapq.heappush(load, (least + size, shard))
    return placed


def rebalanced(placed: list[int], sums: dict[int, tuple[int, int]], n_shards: int) -> list[int]:
    """The map edited for more shards: each new shard takes slots from the fullest shards until it has its fair
    share; no slot moves between the old ones."""
    placed, old = list(placed), max(placed, default=-1) + 1
    if n_shards <= old:
        raise ValueError(f"{n_shards} shards are no more than the {old} there are")
    fair = sum(b for b, _ in sums.values()) / n_shards
    load = [0] * n_shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(old)]
    for slot, (size, _) in sums.items():
        load[placed[slot]] += size
        held[placed[slot]].append((size, slot))
    for own in held:
        own.sort(reverse=True)
    heap = [(-load[s], s) for s in range(old)]
    heapq.heapify(heap)
    for new in range(old, n_shards):
        while heap:
            _, donor = heapq.heappop(heap)
            room = fair - load[new]
            pick = next((x for x in held[donor] if x[0] <= room and x[0] > 0), None)
            if pick is None or load[donor] <= fair:
                continue
            held[donor].remove(pick)
            placed[pick[1]] = new
            load[new] += pick[0]
            load[donor] -= pick[0]
            heapq.heappush(heap, (-load[donor], donor))
        heap = [(-load[s], s) for s in range(old)]
        heapq.heapify(heap)
    return placed


def shrunk(placed: list[int], sums: dict[int, tuple[int, int]], n_shards: int) -> list[int]:
    """The map edited for fewer shards: the slots of those that go, the heaviest first, each to the lightest that stays; no other slot moves."""
    load = [0] * n_shards
    for slot, (size, _) in sums.items():
        if placed[slot] < n_shards:
            load[placed[slot]] += size
    heap = [(b, shard) for shard, b in enumerate(load)]
    heapq.heapify(heap)
    out = [shard if shard < n_shards else slot % n_shards for slot, shard in enumerate(placed)]
    for slot in sorted((s for s in sums if placed[s] >= n_shards), key=lambda s: (-sums[s][0], s)):
        least, out[slot] = heapq.heappop(heap)
        heapq.heappush(heap, (least + sums[slot][0], out[slot]))
    return out


def levelled(placed: list[int], sums: dict[int, tuple[int, int]], n_shards: int) -> list[int]:
    """The map itself if no shard is more than ``BAND`` above the fair share; else edited: the fullest shard gives the emptiest a slot of at most half their difference, until all are within
    ``EVEN`` of the fair share or have no such slot."""
    load = [0] * n_shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, (size, _) in sums.items():
        load[placed[slot]] += size
        held[placed[slot]].append((size, slot))
    fair = sum(load) / n_shards
    if max(load) <= fair * (1 + BAND):
        return placed
    placed = list(placed)
    for own in held:
        own.sort()
    full = set(range(n_shards))
    while full:
        donor, taker = max(full, key=lambda k: (load[k], k)), min(range(n_shards), key=lambda k: (load[k], k))
        if load[donor] <= fair * (1 + EVEN):
            break
        at = bisect_right(held[donor], ((load[donor] - load[taker]) // 2, len(placed))) - 1
        if at < 0 or held[donor][at][0] == 0:
            full.remove(donor)
            continue
        size, slot = held[donor].pop(at)
        insort(held[taker], (size, slot))
        placed[slot] = taker
        load[donor] -= size
        load[taker] += size
    return placed


def save_map(spark: SparkSession, placed: list[int], path: str, version: int, hot: list[int] | None = None) -> None:
    """Stores one version of the map, and of the hot groups, as one file, in place of what a lost writer may have left of it; earlier versions stay readable."""
    rows = spark.range(len(placed)).select(F.col("id").cast("int").alias("slot"), _element(placed, F.col("id")).cast("int").alias("shard"), F.lit(None).cast("long").alias("hot"))
    groups = F.explode(F.array(*map(F.lit, hot or [])).cast("array<bigint>"))
    rows = rows.unionByName(spark.range(1).select(F.lit(None).cast("int").alias("slot"), F.lit(None).cast("int").alias("shard"), groups.alias("hot")))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    return [r["shard"] for r in spark.read.parquet(f"{path}/version={version}").filter("slot is not null").orderBy("slot").collect()]


def load_hot(spark: SparkSession, path: str, version: int) -> list[int]:
    return sorted(r["hot"] for r in spark.read.parquet(f"{path}/version={version}").filter("hot is not null").collect())


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the last version stored below the path, 0 if there is none."""
    try:
        return spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException:  # nothing was stored there yet
        return 0


def stored_map(records: DataFrame, path: str, n_shards: int, slots: int = SLOTS) -> tuple[DataFrame, dict[int, tuple[int, int]], list[int]]:
    """The slotted records, their slots' sums and the map as the latest stored version has it. Stores the first one, or an edited one if there are more or fewer shards, further hot groups than it knows, or a shard that has
    outgrown its share."""
    spark = records.sparkSession
    version = latest_version(spark, path)
    known = load_hot(spark, path, version) if version else []
    hot = sorted({*known, *hot_groups(records, n_shards, slots)})
    own = slotted(records, hot, slots)
    sums = slot_sums(own)
    placed = stored = load_map(spark, path, version) if version else []
    if not version:
        placed = first_map(sums, n_shards, slots)
    else:
        have = max(stored) + 1
        placed = rebalanced(stored, sums, n_shards) if n_shards > have else shrunk(stored, sums, n_shards) if n_shards < have else stored
        placed = levelled(placed, sums, n_shards)
    if placed != stored or hot != known:
        save_map(spark, placed, path, version + 1, hot)
    return own, sums, load_map(spark, path, latest_version(spark, path))


def shard_documents(docs: DataFrame, n_shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the record's place in its shard, gapless from 0), grown_shard (null
    under this law), virtual_slot. ``path``: where the versions of the map are stored; by default a new one in the shared folder."""
    records, sums, placed = stored_map(slim(docs), path or fresh_path(docs.sparkSession, "slot-map"), n_shards, slots)
    before, filled = [0] * slots, [0] * n_shards
    for slot in range(slots):
        before[slot] = filled[placed[slot]]
        filled[placed[slot]] += sums.get(slot, (0, 0))[1]
    order = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return records.select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        _element(placed, F.col("virtual_slot")).cast("int").alias("shard"),
        (_element(before, F.col("virtual_slot")) + F.row_number().over(order) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
