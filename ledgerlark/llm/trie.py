"""The prefix trie of conversations, family first: every family's small trie is built where its conversations meet, and only its combined nodes are shuffled to be merged with the other families'.

A family is the conversations c with one base id, c - c % ``FAMILY`` (the remainder has the sign of c). A conversation is rebuilt from the first h turns of its base and its own turns after its first h;
h is the CRC-32 of its decimal id modulo ``CYCLE``. The base belongs to its family, so one shuffle by base id is the cogroup of both.

1. A turn becomes 16 bytes of SHA-256 and a length where it lies; texts aren't shuffled. Within a family turns stream by position, and a node's key is the hash of its parent's key and its turn. No more than
   ``CYCLE`` levels of one family are held, each with a node for each of its conversations at most, however long these are.
2. The families' nodes are merged by key: members add up, the smallest id stays, a node is inner if it is so anywhere. A key is met once a family, and sums are taken before the shuffle.
3. The merged values go back to the families. A node is owned by the family of its smallest member, which holds the whole path to it, so each family adds up what it owns below each of its nodes, from
   the deepest level upwards. Merged by key again, these sums are those of the whole subtrees.
4. The ids that end at a node stream through SHA-256 in the order of the families, whose ids are ranges that don't overlap. That hash is sequential by its contract: all families in which a conversation ends at one node pass
   through one task, as short strings, without being held.

Nulls: a null role or text is empty, a null turn comes first, rows without a conv_id are left out. Turns of one number stand in the order of their digests; a repeated row is another turn. A conversation that
is rebuilt without a turn is a member of the root. An empty table has no node. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.llm.shared import parallelism, written

FAMILY, CYCLE = 100, 6
ROOT = bytes(16)
#: Rows of a batch that a task sends.
ROWS = 10_000
NODES = "key binary, parent binary, depth long, chars long, base long, n_convs long, conv_id long, inner boolean, ends string"
SUMS = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def base_id(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def kept(conv_id: int) -> int:
    """How many of its base's turns a conversation begins with."""
    return zlib.crc32(str(conv_id).encode()) % CYCLE


def turns(conversations: DataFrame) -> DataFrame:
    """base, conv_id, pos (from 1), digest, chars of the turns, a family in one partition, by position and conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars")).filter("conv_id is not null")
    families = own.withColumn("base", base_id(F.col("conv_id"))).repartition(parallelism(conversations.sparkSession), "base")
    pos = F.row_number().over(W.partitionBy("base", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return families.select("base", "conv_id", pos.alias("pos"), "digest", "chars").sortWithinPartitions("base", "pos", "conv_id")


def batched(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield batch()
            held.clear()
    yield batch()


class Family:
    """The trie of one family while its turns come by position. Levels that no further turn can reach are handed out."""

    def __init__(self, base: int):
        self.base, self.levels = base, {0: {ROOT: [ROOT, 0, 0, 0, None, [], False]}}
        self.first: list[tuple] = []  # turns up to CYCLE - 1, until the family's base is known
        self.at: dict[int, bytes] = {}  # the node that each conversation has come to
        self.shift: dict[int, int] = {}
        self.open: set[int] = set()

    def step(self, conv: int, depth: int, digest: bytes, chars: int) -> None:
        parent = self.at[conv]
        self.levels[depth - 1][parent][6] = True
        self.enter(conv, depth, hashlib.blake2b(parent + digest, digest_size=16).digest(), parent, chars)

    def enter(self, conv: int, depth: int, key: bytes, parent: bytes, chars: int) -> None:
        node = self.levels.setdefault(depth, {}).setdefault(key, [parent, depth, chars, 0, None, [], False])
        node[3] += 1
        node[4] = conv if node[4] is None else min(node[4], conv)
        self.at[conv] = key

    def begin(self) -> None:
        """All conversations' first turns: their base's, then their own."""
        base = [(digest, chars) for conv, _, digest, chars in self.first if conv == self.base]
        for conv in sorted({conv for conv, *_ in self.first}):
            h = kept(conv)
            self.shift[conv] = min(h, len(base)) - h
            self.enter(conv, 0, ROOT, ROOT, 0)
            for depth, (digest, chars) in enumerate(base[:h], 1):
                self.step(conv, depth, digest, chars)
        for conv, pos, digest, chars in self.first:
            if pos > kept(conv):
                self.step(conv, pos + self.shift[conv], digest, chars)
        counts: dict[int, int] = {}
        for conv, *_ in self.first:
            counts[conv] = counts.get(conv, 0) + 1
        self.open = {conv for conv, n in counts.items() if n == CYCLE - 1}
        for conv in counts.keys() - self.open:
            self.end(conv, counts[conv])
        self.first = []

    def end(self, conv: int, pos: int) -> None:
        depth = max(pos, kept(conv)) + self.shift[conv]
        self.levels[depth][self.at.pop(conv)][5].append(conv)

    def take(self, pos: int, rows: list[tuple]) -> Iterator[tuple]:
        """All turns of one position; what can be handed out after it."""
        if pos < CYCLE:
            self.first += rows
            return
        if pos == CYCLE:
            self.begin()
        for conv, _, digest, chars in rows:
            self.step(conv, pos + self.shift[conv], digest, chars)
        now = {conv for conv, *_ in rows}
        for conv in self.open - now:
            self.end(conv, pos - 1)
        self.open = now
        yield from self.out([d for d in self.levels if d <= pos - CYCLE])

    def close(self, pos: int) -> Iterator[tuple]:
        if pos < CYCLE:
            self.begin()
        for conv in self.open:
            self.end(conv, max(pos, CYCLE - 1))
        yield from self.out(sorted(self.levels))

    def out(self, depths: list[int]) -> Iterator[tuple]:
        for depth in depths:
            for key, (parent, _, chars, n, least, ends, inner) in self.levels.pop(depth).items():
                yield key, parent, depth, chars, self.base, n, least, inner, ",".join(map(str, sorted(ends))) if ends else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def family_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def nodes() -> Iterator[tuple]:
        family, at, group = None, 0, []
        for base, conv, pos, digest, chars in _rows(batches):
            if family is not None and (base != family.base or pos != at):
                yield from family.take(at, group)
                group = []
                if base != family.base:
                    yield from family.close(at)
                    family = None
            family, at = family or Family(base), pos
            group.append((conv, pos, digest, chars))
        if family is not None:
            yield from family.take(at, group)
            yield from family.close(at)

    return batched(nodes(), NODES)


def family_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each family owns below each of its nodes; rows come by family, the deepest level first. Two levels of one family are held."""

    def sums() -> Iterator[tuple]:
        family, level, above, below = None, None, {}, {}
        for base, depth, key, parent, chars, n, conv, inner in _rows(batches):
            if base != family or depth != level:
                family, level, above, below = base, depth, {}, above
            owned = (conv - conv % FAMILY if conv >= 0 else conv + -conv % FAMILY) == base
            saved, leaves, children, waiting = below.pop(key, (0, 0, 0, ()))
            for row in waiting:
                yield *row[:3], conv, *row[3:]
            saved += (n - 1) * chars if owned else 0
            leaves += owned and not inner
            row = key, conv, depth, n, children, leaves, saved
            if not depth:
                yield *row[:3], None, *row[3:]
                continue
            found = above.setdefault(parent, [0, 0, 0, []])
            found[0] += saved
            found[1] += leaves
            found[2] += owned
            if owned or saved or leaves or children:
                found[3].append(row)

    return batched(sums(), SUMS)


def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def hashes() -> Iterator[tuple]:
        now, sha = None, None
        for key, ids in _rows(batches):
            if key != now:
                if now is not None:
                    yield now, sha.hexdigest()
                now, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if now is not None:
            yield now, sha.hexdigest()

    return batched(hashes(), "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    tasks = parallelism(conversations.sparkSession)
    local = written(turns(conversations).mapInArrow(family_nodes, NODES), "nodes")
    merged = local.groupBy("key").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("inner").alias("inner"))
    back = local.select("base", "depth", "key", "parent", "chars").join(merged, "key").select("base", "depth", "key", "parent", "chars", "n_convs", "conv_id", "inner")
    sums = back.repartition(tasks, "base").sortWithinPartitions("base", F.desc("depth")).mapInArrow(family_sums, SUMS)
    ends = local.filter("ends is not null").select("key", "base", "ends").repartition(tasks, "key").sortWithinPartitions("key", "base").select("key", "ends").mapInArrow(hashed_ends, "key binary, ends_sha256 string")
    same = [F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")]
    added = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    nodes = sums.unionByName(ends, allowMissingColumns=True).groupBy("key").agg(*same, *added, F.coalesce(F.max("ends_sha256"), none).alias("ends_sha256"))
    return nodes.drop("key")
