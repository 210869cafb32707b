"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets are the sources' shares of all words, capped at a multiple of what a source has. Blocks of
equal size go to the sources with the highest quotients ``target / (2 k + 1)``, then within a source
to its shards, by the same rule. A source whose target is worth few blocks takes part in an
apportionment of smaller ones, as wide as its target over the words of a block, so that no source
goes without. A shard takes its whole stream as often as its quota allows and the
rest from blocks in a seeded order. A shard holds about ``shard_words`` words, so a source with a third
of all rows is just more shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderloom.llm.common import row_id, shown_id, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS, SHARD_WORDS = 64, 1_000_000
SEED = 41


def sizes(docs: DataFrame) -> DataFrame:
    """``(did, th, source, size)`` of each row, size in words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        row_id().alias("did"),
        F.hash(text).alias("th"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)``: one row per source, of which there are few.

    Every source would take words in proportion to its weight; those that can't are held at ``most``
    times their size, and the others share the rest. Sources are met in the order in which a rising
    level per weight fills them, so one pass finds those that are held.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    full = (F.lit(most) * F.col("source_size")).cast("double")
    order = W.orderBy("level", "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seen = (
        each.select("*", weight.cast("double").alias("weight"), full.alias("full"))
        .withColumn("level", F.col("full") / F.col("weight"))
        .select(
            "*",
            F.sum("source_size").over(everything).cast("double").alias("total"),
            F.coalesce(F.sum("full").over(before), F.lit(0.0)).alias("held_before"),
            F.sum("weight").over(after).alias("weight_left"),
        )
        .withColumn("held", (F.col("total") - F.col("held_before")) / F.col("weight_left") >= F.col("level"))
    )
    rest = F.col("total") - F.sum(F.when(F.col("held"), F.col("full")).otherwise(0.0)).over(everything)
    sharing = F.sum(F.when(F.col("held"), 0.0).otherwise(F.col("weight"))).over(everything)
    share = F.col("weight") * rest / sharing
    return seen.select(
        "source", "source_size", F.when(F.col("held"), F.col("full")).otherwise(share).alias("target")
    )


def apportion(parts: DataFrame, within: list[str], key: str, weight: str, seats: Column) -> DataFrame:
    """``parts`` with ``quota``: ``seats`` handed to the parts by highest quotients, ties to the
    smaller ``key``. ``weight`` isn't negative; ``within`` names the groups that share seats.

    Only the last few seats are contested. With S parts, the divisor that fits lies so close to the
    total over the seats that a part surely gets its share of ``seats - S/2``, less one; these are
    given at once, and the rest by ranking about six quotients a part.
    """
    every = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    known = parts.select(
        "*",
        seats.alias("__seats"),
        F.sum(weight).over(every).alias("__all"),
        F.count(F.lit(1)).over(every).alias("__parts"),
    )
    share = F.when(F.col("__all") > 0, F.col(weight) / F.col("__all")).otherwise(0.0)
    sure = F.floor(share * (F.col("__seats") - F.col("__parts") / 2)) - 1
    known = known.withColumn("__share", share).withColumn("__sure", F.greatest(sure, F.lit(0)).cast("long"))
    known = known.withColumn("__open", F.col("__seats") - F.sum("__sure").over(every))
    more = (F.col("__share") * F.col("__parts")).cast("long") + 5
    ranked = known.withColumn(
        "__k", F.explode(F.sequence(F.col("__sure"), F.col("__sure") + more))
    ).withColumn("__quotient", F.col(weight) / (2 * F.col("__k") + 1))
    order = every.orderBy(F.col("__quotient").desc(), F.col(key).asc_nulls_last(), "__k")
    ranked = ranked.withColumn("__rank", F.row_number().over(order))
    won = (F.col("__rank") <= F.col("__open")) & (F.col(weight) > 0)
    columns = [c for c in parts.columns]
    return ranked.groupBy(*columns, "__sure").agg(F.sum(won.cast("long")).alias("__won")).select(
        *columns, (F.col("__sure") + F.col("__won")).alias("quota")
    )


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``(did, th, size, source, source_size, target, taken)`` of each row.

    A null or empty text has size 0 and is taken 0 times; a null source is a source, the last one; a
    null id stays null; repeated rows are taken each for itself; an empty table gives an empty one;
    texts and sources may have any length and size, and extra columns are left behind.
    ``taken`` is at most ``most`` times the size, and a run on the same rows takes the same words.
    """
    sized = written(sizes(docs), "mixing-sizes")
    wanted = targets(sized, weights, most)
    width = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("target") / block_words)))
    wanted = wanted.withColumn("width", width.cast("long"))
    blocks = F.round(F.sum("target").over(W.partitionBy("width")) / F.col("width")).cast("long")
    quotas = written(
        apportion(wanted.withColumn("seats", blocks), ["width"], "source", "target", F.col("seats"))
        .withColumnRenamed("quota", "source_quota")
        .withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long"))
        .drop("seats"),
        "mixing-quotas",
    )
    # A handful of rows per source beside all documents: Spark broadcasts it only while it is small.
    place = F.pmod(F.xxhash64(F.lit(seed), "did", "th"), F.col("shards"))
    both = sized.withColumnRenamed("source", "name").join(
        quotas, F.col("name").eqNullSafe(F.col("source")), "left"
    )
    rows = both.select("did", "th", "size", "source", "source_size", "target", "width", place.alias("shard"))

    shards = (
        rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
        .withColumnRenamed("source", "name")
        .join(quotas.select("source", "source_quota", "width"), F.col("name").eqNullSafe(F.col("source")))
        .drop("name")
    )
    shards = apportion(shards, ["source"], "shard", "shard_size", F.col("source_quota"))
    take = F.least(F.col("quota") * F.col("width"), most * F.col("shard_size"))
    shards = (
        shards.withColumn("take", take)
        .withColumn("passes", F.when(F.col("shard_size") > 0, F.floor(F.col("take") / F.col("shard_size"))).otherwise(0))
        .withColumn("rest", F.col("take") - F.col("passes") * F.col("shard_size"))
        .select("source", "shard", "shard_size", "width", "passes", "rest")
    )
    shards = written(shards, "mixing-shards")

    in_shard = W.partitionBy("source", "shard")
    stream = in_shard.orderBy(F.xxhash64(F.lit(seed + 1), "did", "th"), "did", "th", "size")
    placed = rows.where("size > 0").withColumn(
        "start", F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    )
    width = F.col("width")
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last))).select(
        "*",
        (F.greatest("start", F.col("block") * width) - F.col("block") * width).alias("from"),
        F.least(F.col("start") + F.col("size") - F.col("block") * width, width).alias("to"),
    )
    lasting = F.ceil(F.col("shard_size") / width) - 1
    cut = shards.where("shard_size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), lasting)))
    words = F.least(width, F.col("shard_size") - F.col("block") * width)
    seeded = in_shard.orderBy(F.xxhash64(F.lit(seed + 2), "shard", "block"), "block")
    chosen = (
        cut.withColumn("words", words)
        .withColumn("before", F.sum("words").over(seeded.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("open", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
        .select(F.col("source").alias("b_source"), F.col("shard").alias("b_shard"), F.col("block").alias("b_block"), "passes", "open")
    )
    on = (
        F.col("source").eqNullSafe(F.col("b_source"))
        & (F.col("shard") == F.col("b_shard"))
        & (F.col("block") == F.col("b_block"))
    )
    part = F.greatest(F.lit(0), F.least(F.col("to"), F.col("open")) - F.col("from"))
    keys = ["did", "th", "size", "source", "source_size", "target"]
    # Rows of one document that stand at different places of a stream are different rows.
    taken = (
        # Both sides grow with the words, whatever size the planner takes them for.
        pieces.join(chosen.hint("merge"), on)
        .groupBy(*keys, "shard", "start")
        .agg((F.sum(part) + F.first("passes") * F.col("size")).cast("long").alias("taken"))
        .select(*keys, "taken")
    )
    return taken.unionByName(rows.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken")))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """``mixed`` in the form of a report, one row per document."""
    return mixed(docs, **settings).select(
        shown_id().alias("doc_id"), "size", "source_size", "target", "taken"
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with all their columns and ``taken``; of
    repeated rows each gets the mean of what they are taken."""
    drawn = (
        mixed(docs, **settings)
        .groupBy(F.col("did").alias("__did"), F.col("th").alias("__th"))
        .agg(F.floor(F.avg("taken")).cast("long").alias("__taken"))
        .where("__taken > 0")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    on = (row_id() == F.col("__did")) & (F.hash(text) == F.col("__th"))
    own = [F.col(c) for c in docs.columns if c != "taken"]
    return docs.join(drawn, on).select(*own, F.col("__taken").alias("taken"))
