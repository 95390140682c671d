"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source has a weight; targets are filled like water under a cap of ``max_repeat`` times what the source has. The
targets are turned into whole blocks of ``block_tokens`` words: blocks go one by one to the source with the highest
quotient target / (2 * blocks so far + 1). A source's documents stand in seeded random order, end to end, cut into blocks that are dealt to ``N_SHARDS``
shards in turn. Where the quota is the whole source and more, every shard takes all of its blocks once (or twice); what is left of the quota is spread over the shards in whole
numbers, at most one apart (``shard_quotas``), and each shard takes its part from its own blocks, as many as its quota from a seeded one on. Less than a block, which is
left over where a source's size isn't a multiple of the block, comes from the beginning of the next block that wasn't chosen.

All is DataFrame functions. Running sums over a source go through 1024 ranges of the random order, so that a
source with a third of all rows is summed by many tasks. Only tables of one row per source, and per source and
range, are windowed.

Nulls: a null text has size 0; a null source is one source, the last; a null ``doc_id`` is kept. Repeated rows count each time. An empty
table gives an empty result. Columns besides doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.llm.shared import written

WEIGHTS = (5, 2, 1)
#: Words of a block in the production mix, and the shards over which a source's quota is spread.
BLOCK, N_SHARDS = 16, 40
WORD = r"[^\x20\x09-\x0D]+"


def seeded(seed: int, c: Column) -> Column:
    """60 bits of the MD5 of seed and value as a number: the same in any SQL engine. A null is the word null."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(c.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("bigint")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        seeded(seed, F.col("doc_id")).alias("_order"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """source, source_size, weight, target: one row per source.

    With the sources in order of cap / weight, a source is capped if the level that the rest would reach with all
    before it capped is not below its own cap / weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    above = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    everywhere = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cycle = F.array(*[F.lit(w) for w in weights])
    own = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
        .withColumn("_cap", (max_repeat * F.col("source_size")).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_total", share * F.sum("source_size").over(everywhere))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(above), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("_open", F.col("_level") < F.col("_ratio"))
        .withColumn("_water", F.max(F.when(F.col("_open") & ~F.coalesce(F.max("_open").over(above), F.lit(False)), F.col("_level"))).over(everywhere))
    )
    return own.select(
        "source", "source_size", "weight",
        F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * F.col("_water"))).alias("target"),
    )


def quotas(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``blocks``: the source's seats among round(sum of targets / block) by highest quotients.

    A common divisor already seats nearly all: it is right to within a source's share of half the number of sources, so only
    the quotients within that margin are ranked, not one per block.
    """
    everywhere = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("target").over(everywhere)
    near = (
        goal.withColumn("_seats", F.round(total / block).cast("long"))
        .withColumn("_share", F.when(total > 0, F.col("target") / total).otherwise(0.0))
        .withColumn("_mid", F.round(F.col("_share") * F.col("_seats")).cast("long"))
        .withColumn("_margin", F.ceil(F.col("_share") * F.count("*").over(everywhere)) + 2)
        .withColumn("_low", F.greatest(F.lit(0), F.col("_mid") - F.col("_margin")))
        .withColumn("_left", F.col("_seats") - F.sum("_low").over(everywhere))
    )
    ranked = near.withColumn("_s", F.explode(F.sequence("_low", F.col("_mid") + F.col("_margin")))).withColumn(
        "_rank", F.row_number().over(W.orderBy((F.col("target") / (2 * F.col("_s") + 1)).desc(), F.col("source").asc_nulls_last(), "_s"))
    )
    return ranked.groupBy("source", "source_size", "weight", "target").agg(
        (F.first("_low") + F.sum(F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0))).cast("long").alias("blocks")
    )


def _first_shard(n_shards: int) -> Column:
    """Where a source's odd blocks start: at the shard where those of the source before it ended."""
    return F.coalesce(F.sum(F.pmod("blocks", F.lit(n_shards))).over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def shard_quotas(quota: DataFrame, n_shards: int) -> DataFrame:
    """source, shard, blocks: whole blocks per shard, at most one apart within a source; the odd blocks of
    each source start at the shard where those of the source before it ended."""
    return quota.withColumn("_at", _first_shard(n_shards)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).select(
        "source", "shard",
        (F.floor(F.col("blocks") / n_shards) + F.when(F.pmod(F.col("shard") - F.col("_at"), F.lit(n_shards)) < F.pmod("blocks", F.lit(n_shards)), 1).otherwise(0)).cast("long").alias("blocks"),
    )


def selections(quota: DataFrame, seed: int, block: int, max_repeat: int, n_shards: int) -> DataFrame:
    """_source, source_size, target, blocks, _whole (times that all of it is taken), _picks (of each shard, from the first: how many of its blocks, n, are taken once more, taken, and
    from which on, begin), _rest (words besides those) and _rest_at (where they begin). One row per source."""
    run = F.least(F.col("blocks") * block, max_repeat * F.col("source_size"))
    filled = F.col("source_size") > 0
    each = quota.withColumn("_whole", F.when(filled, F.floor(run / F.col("source_size"))).otherwise(0)).withColumn("_left", F.when(filled, run % F.col("source_size")).otherwise(0))
    each = each.select(
        "source", "source_size", "target", F.col("blocks").alias("_quota"), "_whole", F.floor(F.col("_left") / block).alias("blocks"), (F.col("_left") % block).alias("_rest"), F.floor(F.col("source_size") / block).alias("_n")
    ).withColumn("_at", F.pmod(_first_shard(n_shards), F.lit(n_shards)))
    dealt = shard_quotas(each.select("source", "blocks"), n_shards).select(F.col("source").alias("_s"), "shard", F.col("blocks").alias("_taken"))
    placed = each.join(dealt, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_pos", F.pmod(F.col("shard") - F.col("_at"), F.lit(n_shards)))
    own = F.floor(F.col("_n") / n_shards) + F.when(F.col("_pos") < F.col("_n") % n_shards, 1).otherwise(0)
    start = F.pmod(seeded(seed, F.concat_ws(":", F.coalesce("source", F.lit("null")), "shard")), F.greatest(own, F.lit(1)))
    pick = F.struct(F.col("_pos").alias("pos"), own.cast("long").alias("n"), F.col("_taken").alias("taken"), start.alias("begin"))
    picks = placed.groupBy("source", "source_size", "target", "_quota", "_whole", "blocks", "_rest", "_n").agg(F.array_sort(F.collect_list(pick)).alias("_picks"))
    next_ = F.get("_picks", F.pmod("blocks", F.lit(n_shards)).cast("int"))  # the first shard that has a block it didn't take
    place = F.pmod(next_["begin"] + next_["taken"], F.greatest(next_["n"], F.lit(1))) * n_shards + F.pmod("blocks", F.lit(n_shards))
    return picks.select(
        F.col("source").alias("_source"), "source_size", "target", F.col("_quota").alias("blocks"), "_whole", "_picks", "_rest",
        (F.when(F.col("blocks") < F.col("_n"), place).otherwise(F.col("_n")) * block).alias("_rest_at"),
    )


def mix(docs: DataFrame, seed: int = 42, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeat: int = 2, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, source, size, source_size, target, blocks (its source's quota), taken: one row per document."""
    sizes = written(sized(docs, seed), "mix")
    quota = selections(quotas(targets(sizes, weights, share, max_repeat), block), seed, block, max_repeat, n_shards)
    ranged = sizes.withColumn("_range", F.shiftright("_order", 50).cast("int"))
    starts = (
        ranged.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(quota, F.col("source").eqNullSafe(F.col("_source")))
        .select("_source", F.col("_range").alias("_r"), "_base", "source_size", "target", "blocks", "_whole", "_picks", "_rest", "_rest_at")
    )
    inside = W.partitionBy("source", "_range").orderBy("_order", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        ranged.withColumn("_end", F.sum("size").over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
        .withColumn("_to", F.col("_base") + F.col("_end"))
        .withColumn("_at", F.col("_to") - F.col("size"))
    )
    within = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("_to"), hi) - F.greatest(F.col("_at"), lo))

    def chosen(k: Column) -> Column:
        pick = F.get("_picks", (k % n_shards).cast("int"))
        return (k < F.floor(F.col("source_size") / block)) & (F.pmod(F.floor(k / n_shards) - pick["begin"], pick["n"]) < pick["taken"])

    touched = F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_to") - 1) / block))
    picked = F.aggregate(touched, F.lit(0).cast("long"), lambda n, k: n + F.when(chosen(k), within(k * block, (k + 1) * block)).otherwise(0).cast("long"))
    once = F.when(F.col("size") > 0, picked).otherwise(0) + within(F.col("_rest_at"), F.col("_rest_at") + F.col("_rest"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "blocks", (F.col("_whole") * F.col("size") + once).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: each as often as round(taken / size). Rows that share
    a doc_id share what is taken of them; a document without words is left out, as the mix takes no word of it."""
    counts = mix(docs, seed).groupBy(F.col("doc_id").alias("_id")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    copies = counts.select("_id", F.when(F.col("_size") > 0, F.round(F.col("_taken") / F.col("_size"))).otherwise(0).cast("int").alias("_copies")).filter("_copies > 0")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    joined = docs.join(copies, docs["doc_id"].eqNullSafe(copies["_id"]))
    return joined.select(whole, F.explode(F.sequence(F.lit(1), copies["_copies"])).alias("copy")).select("row.*")
