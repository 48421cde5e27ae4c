"""Mixing of sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Words are dealt in blocks of equal length. Sources get blocks by the highest quotients target / (2k + 1), then each
source's shards by the highest quotients size / (2k + 1). A shard's documents stand one behind the other in a seeded order
and are read round and round: its quota of blocks begins at a seeded block, so that it takes exactly its quota of words,
whole rounds first, and a document gives words of each round that meets it.

Quotas need no list of all quotients. With V votes and N blocks for m parties, those of at least V / 2(N - m) are at most
N, and those of at least V / 2(N + m) at least N; the first are counted by arithmetic, and of the 3m quotients between,
the highest are taken. They are ranked by sorted ranges, so no task holds all parties, and nothing goes through the driver
but sums. Shards hold about SHARD_DOCS documents each, so a source of any size has as many shards as it needs. Rows that
are equal in source, id and size are counted before they are dealt, and share what they take in order.

Targets stop at 3 times a source's size: sources above are cut, and the excess is shared by weight among the others, again
and again until none is above (each round is one sum over the sources; what is left over when all are at their bound is
not given out). A shard takes no more blocks than 3 times its size holds, so that no document exceeds 3 times its own.

Odd rows: a null text has size 0; a null source is a source of its own and comes last; null ids are ids. Documents without
a word take nothing. Equal quotients go to the source, or shard, that comes first. An empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.series import numbered
from .common import written

#: The contract's weights by place of the source, and the bound of repeats. Fixed values.
WEIGHTS = (1, 2, 3)
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Plan:
    block: int = 32
    shard_docs: int = 4096
    seed: str = "mix"


def seeded(plan: Plan, *parts: Column | str) -> Column:
    """48 bits of a digest, the same wherever it is made."""
    text = F.concat_ws(":", F.lit(plan.seed), *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, copies), written: the texts are read once."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    counted = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size")).groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    return written(counted, "mix-sized")[0]


def targets(sizes: DataFrame) -> DataFrame:
    """(source, place, docs, source_size, target), written: weights by place, cut at the bound until none is above it."""
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("docs"))
    placed = numbered(totals.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "place").drop("_last")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") - 1).cast("int") % len(WEIGHTS) + 1)
    sources = written(placed.withColumn("weight", weight.cast("long")), "mix-sources")[0]  # an int times the sum of sizes would be an int
    bound = F.col("source_size") * REPEATS
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(1)).alias("w")).first()
    left, weights, cut = total["t"], total["w"], -1
    while True:  # shares only grow, so what is cut once stays cut
        share = F.col("weight") * left / weights
        above = sources.agg(F.count_if(bound < share).alias("n"), F.sum(F.when(bound < share, bound)).alias("taken"), F.sum(F.when(bound < share, F.col("weight"))).alias("weight")).first()
        if above["n"] in (cut, 0) or total["w"] == above["weight"]:
            break
        cut, left, weights = above["n"], total["t"] - above["taken"], total["w"] - above["weight"]
    return sources.withColumn("target", F.least(bound.cast("double"), F.col("weight") * F.lit(float(left)) / F.lit(float(weights))))


def apportioned(parties: DataFrame, votes: str, seats: str, among: list[str], order: list[str]) -> DataFrame:
    """Adds `quota`: Sainte-Lague seats of each party. `seats` are those of its group (columns `among`), equal in the group."""
    group = {"_v": F.sum(votes), "_m": F.count(F.lit(1))}
    sums = parties.groupBy(*among).agg(*(c.alias(n) for n, c in group.items()))
    known = parties.join(sums, among) if among else parties.crossJoin(F.broadcast(sums))  # one row of sums
    v, n = F.col(votes), F.col(seats)

    def up_to(number: Column) -> Column:
        """How many of a party's quotients reach the sum of votes / 2 number."""
        return F.when((number > 0) & (F.col("_v") > 0), F.floor(v * number / F.col("_v") + 0.5)).otherwise(0)

    sure, most = up_to(n - F.col("_m")), F.when(n > 0, up_to(n + F.col("_m"))).otherwise(0)
    spread = written(known.withColumns({"_sure": sure, "_most": most}), "mix-votes")[0]
    open_seats = spread.groupBy(*among).agg((F.max(seats) - F.sum("_sure")).alias("_open"))
    offered = spread.filter("_most > _sure").select(*among, *(c for c in order if c not in among), F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_k"), v.alias("_votes"))
    ranked = numbered(offered.withColumn("_quotient", -F.col("_votes") / (2 * F.col("_k") + 1)), [*among, "_quotient", *order, "_k"], "_rank")
    if among:
        ranked = written(ranked, "mix-ranks")[0]
        firsts = ranked.groupBy(*among).agg((F.min("_rank") - 1).alias("_before"))
        won = ranked.join(firsts.join(open_seats, among), among).filter(F.col("_rank") - F.col("_before") <= F.col("_open"))
    else:
        won = ranked.crossJoin(F.broadcast(open_seats)).filter(F.col("_rank") <= F.col("_open"))
    keys = list(dict.fromkeys([*among, *order]))
    extra = won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_extra"))
    return spread.join(extra, keys, "left").withColumn("quota", F.col("_sure") + F.coalesce("_extra", F.lit(0))).drop("_v", "_m", "_sure", "_most", "_extra")


def mixed(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, shard, quota, taken), a row for each document."""
    sizes = sized(docs, key, text, source)
    sources = targets(sizes)
    blocks = sources.agg(F.coalesce(F.round(F.sum("target") / plan.block), F.lit(0)).cast("long").alias("_blocks"))
    by_source = apportioned(sources.crossJoin(F.broadcast(blocks)), "target", "_blocks", [], ["place"])
    by_source = written(by_source.select("source", "place", "docs", "source_size", "target", F.col("quota").alias("source_quota")), "mix-quotas")[0]
    same = sizes["source"].eqNullSafe(by_source["source"])
    dealt = sizes.join(by_source, same).drop(sizes["source"]).withColumn("shard", seeded(plan, "place", "key") % F.ceil(F.col("docs") / plan.shard_docs))
    shards = dealt.groupBy("place", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("shard_size"), F.max("source_quota").alias("source_quota"))
    quotas = apportioned(shards, "shard_size", "source_quota", ["place"], ["shard"])
    quota = F.least("quota", F.floor(F.col("shard_size") * REPEATS / plan.block))
    start = F.when(F.col("shard_size") > 0, seeded(plan, "place", "shard", F.lit("start")) % F.greatest(F.ceil(F.col("shard_size") / plan.block), F.lit(1)) * plan.block % F.col("shard_size")).otherwise(0)
    quotas = quotas.select("place", "shard", "shard_size", quota.alias("quota"), start.alias("start"))
    # documents stand in a seeded order; the place of each one's first word
    stand = Window.partitionBy("place", "shard").orderBy("_order", "key", "size")
    first = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(stand.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stood = dealt.withColumn("_order", seeded(plan, "key", F.lit("order"))).withColumn("_first", first).join(quotas, ["place", "shard"])
    each = stood.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("_from", F.col("_first") + F.col("_copy") * F.col("size"))
    words = F.col("quota") * plan.block
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0)
    over = F.when(F.col("shard_size") > 0, words - rounds * F.col("shard_size")).otherwise(0)

    def met(begin: Column, end: Column) -> Column:
        return F.greatest(F.least(F.col("_from") + F.col("size"), end) - F.greatest(F.col("_from"), begin), F.lit(0))

    last = F.col("start") + over  # the part of a round goes on at the shard's begin
    taken = rounds * F.col("size") + met(F.col("start"), F.least(last, F.col("shard_size"))) + met(F.lit(0), last - F.col("shard_size"))
    return each.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "shard", "quota", taken.cast("long").alias("taken"))
