"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Targets share ``share`` times all words among the sources by weight; a source's target stops at ``most`` times its size and the
excess goes to the others by weight (the level is found in closed form over the sorted sources). The targets are then cut
into blocks of ``block`` words, and blocks are apportioned to the sources, and each source's blocks to its shards, by highest
quotients v / (2k - 1); a source with a target gets one block at least. A shard takes whole passes over its documents and then the first blocks of their seeded order, so a
document is taken whole numbers of times but for one a shard, which gives its first words; a shard's last block is cut short where its documents end.

A source has one shard for as many words as the square root of its size times ``CELL`` words is, so at least ``CELL`` blocks' worth of words are in each and none goes empty-handed, while a source of
10^13 words is split 70,000 ways. A seat count lies within n v / 2V + 1/2 of its share, for n parties with V votes, so only that many quotients a party are ranked
and the others are sure: n parties rank about 5n quotients. Only a row a source meets in one task (levels, quotients of sources), and a row a shard in its source's; documents meet by shard. No result depends on partitions.

Nulls: a null text has size 0. A null source is a source of its own, after all others. Documents with equal ids are
ordered by size, and equal rows tie without a difference; equal quotients go to the first source or shard. Sources without words have target 0. Texts of any length are counted whole. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import stage

WEIGHTS, SHARE, MOST, BLOCK, CELL, SEED = (5, 2, 1), 1.5, 2, 32, 2048, 20
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row a source."""
    every = Window.partitionBy()
    by_name = every.orderBy(F.col("source").isNull(), "source")
    by_level = every.orderBy("level", "no")
    left = F.col("total") - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return (
        sizes.withColumn("no", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") - 1) % len(weights) + 1).cast("double"))
        .withColumn("cap", (most * F.col("source_size")).cast("double"))
        .withColumn("total", F.sum("source_size").over(every) * share)
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("theta", left / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("theta", F.max(F.when(F.col("theta") <= F.col("level"), F.col("theta"))).over(every))
        .select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("theta")), "cap").alias("target")))


def apportion(votes: DataFrame, group: list[str], party: list[str]) -> DataFrame:
    """Adds ``quota``: the ``seats`` of a group (equal in all its rows) to its parties by ``votes``, ties to the first party."""
    own = Window.partitionBy(*group)
    ranked = own.orderBy(F.desc("quotient"), *(F.col(p).isNull() for p in party), *party)
    least = (
        votes.withColumn("all_votes", F.sum("votes").over(own)).withColumn("parties", F.count("*").over(own))
        .withColumn("share", F.when(F.col("votes") > 0, F.col("votes") / F.col("all_votes")))
        .withColumn("fair", F.floor(F.col("seats") * F.col("share"))).withColumn("about", F.ceil(F.col("parties") * F.col("share") / 2) + 1)
        .withColumn("sure", F.greatest(F.lit(0), F.coalesce(F.col("fair") - F.col("about"), F.lit(0))))
        .withColumn("open", F.col("seats") - F.sum("sure").over(own)))
    seat = least.withColumn("seat", F.explode_outer(F.sequence(F.col("sure") + 1, F.col("fair") + F.col("about") + 1)))
    won = F.max("sure") + F.sum((F.col("seat").isNotNull() & (F.col("rank") <= F.col("open"))).cast("long"))
    return seat.withColumn("quotient", F.col("votes") / (2 * F.col("seat") - 1)).withColumn("rank", F.row_number().over(ranked)).groupBy(*votes.columns).agg(won.alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, cell: int = CELL, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``; taken counts a document's words in the mix, repeats too."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = stage(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")).withColumn("drawn", drawn), "sizes")
    of = sized.groupBy(F.col("source").alias("own")).agg(F.greatest(F.lit(1), F.floor(F.sqrt(F.sum("size") / cell))).cast("long").alias("shards"))
    place = F.conv(F.substring("drawn", 1, 8), 16, 10).cast("long") % F.col("shards")
    sized = sized.join(stage(of, "shards"), F.col("source").eqNullSafe(F.col("own"))).select("doc_id", "source", "size", "drawn", place.alias("shard"))
    cells = sized.groupBy("source", "shard").agg(F.sum("size").alias("votes"))
    goal = targets(cells.groupBy("source").agg(F.sum("votes").alias("source_size")), weights, share, most)
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    goal = apportion(goal.withColumn("votes", F.col("target")).withColumn("seats", seats).withColumn("all", F.lit(0)), ["all"], ["source"])
    goal = goal.select(F.col("source").alias("own"), "source_size", "target", F.when(F.col("target") > 0, F.greatest("quota", F.lit(1))).otherwise(0).alias("seats"))
    cells = apportion(cells.join(goal.select("own", "seats"), F.col("source").eqNullSafe(F.col("own"))).drop("own"), ["source"], ["shard"])
    quota = cells.join(goal.drop("seats"), F.col("source").eqNullSafe(F.col("own"))).select(
        "own", F.col("shard").alias("at"), "source_size", "target",
        F.when(F.col("votes") > 0, F.least(F.lit(most), F.floor(F.col("quota") * block / F.col("votes")))).otherwise(0).alias("passes"), (F.col("quota") * block).alias("words"), "votes",
    )
    before = Window.partitionBy("source", "shard").orderBy("drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    rest = F.when(F.col("passes") < most, F.col("words") - F.col("passes") * F.col("votes")).otherwise(0)
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("before")))
    return placed.join(quota, F.col("source").eqNullSafe(F.col("own")) & (F.col("shard") == F.col("at"))).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def digest(mixed: DataFrame) -> DataFrame:
    """The mix without the name of the source."""
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
