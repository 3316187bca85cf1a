"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Words are the tokens. Sources get whole blocks by highest quotients ``target / (2 k + 1)``, the shards of a source share its
blocks the same way by size, and each shard gives its blocks from a seeded order of its documents. Only sums per source and
per shard are compared; blocks themselves are never rows, since a divisor method can only move a quota by a bounded number
of seats from its exact share. Shards hold a bounded number of words and documents, whatever the size of a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, Scratch, columns, small_side

BLOCK_WORDS = 64
LEAST_BLOCKS = 4  # that the smallest target must hold; below it single words are shared out
SHARD_WORDS = 1 << 18
SHARD_DOCS = 1 << 12
WEIGHTS = (1, 2, 3)


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, repeats: int = 3, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS, seed: int = 0
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: one row per row of ``docs``.

    Sources in code point order, null last, take the weights in turn and share all words of the input; a target stops at
    ``repeats`` times the words of its source and the rest is shared anew by weight. ``taken`` counts the words of a document
    that the mix takes, repeats included, at most ``repeats * size``. Null and blank texts have size 0 and give nothing; an input without words
    has targets 0. Blocks have ``block_words`` words, or one where the smallest target is below ``LEAST_BLOCKS`` of them, so small sources
    come near their targets too. Rows with equal id and size are interchangeable. Reruns agree: the order comes from a hash of seed and id.
    """
    with Scratch(docs.sparkSession) as scratch:
        given = columns(docs, doc_id=doc_id, text=text, source=source)
        key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        turn = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")
        sizes = scratch.keep(given.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), turn.alias("turn")))
        sources = scratch.keep(_targets(sizes, weights, repeats, shard_words, shard_docs))
        whole = Window.partitionBy("whole")
        least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole)
        sources = sources.withColumn("whole", F.lit(1)).withColumn("block", F.when(least < LEAST_BLOCKS * block_words, 1).otherwise(block_words))
        sources = scratch.keep(apportion(sources, "whole", "k", "target", F.round(F.sum("target").over(whole) / F.col("block")).cast("long")))

        table = small_side(sources.select("source", "k", "source_size", "target", "shards"), sources.count(), 64)
        placed = sizes.join(table, sizes["source"].eqNullSafe(table["source"])).select("doc_id", "size", "turn", "k", "source_size", "target", (F.col("turn") % F.col("shards")).alias("shard"))
        placed = scratch.keep(placed, release=True)
        shards = placed.groupBy("k", "shard").agg(F.sum("size").alias("shard_size")).where("shard_size > 0")
        seats = sources.select("k", "block", F.col("seats").alias("source_seats"))
        shards = apportion(shards.join(small_side(seats, sources.count(), 16), "k").withColumn("weight", F.col("shard_size").cast("double")), "k", "shard", "weight", F.col("source_seats"))
        need = scratch.keep(shards.select("k", "shard", "shard_size", F.least(F.col("seats") * F.col("block"), F.col("shard_size") * repeats).alias("need")), release=True)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("k", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passes = F.floor(F.col("need") / F.col("shard_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - passes * F.col("shard_size") - F.col("before")))
    ordered = placed.withColumn("before", before).join(need, ["k", "shard"], "left")
    return ordered.select("doc_id", "size", "source_size", "target", F.coalesce(passes * F.col("size") + part, F.lit(0)).cast("long").alias("taken"))


def _targets(sizes: DataFrame, weights: Sequence[int], repeats: int, shard_words: int, shard_docs: int) -> DataFrame:
    """``(source, k, source_size, target, shards)``, one row per source; its windows hold one row per source.

    Sources in order of the share at which they would be full: those full at the level that the others leave stop there.
    """
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = per.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", turn.cast("long")).withColumn("cap", F.col("source_size") * repeats)
    whole, earlier = Window.partitionBy(F.lit(1)), Window.orderBy(F.col("cap") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    left_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(earlier), F.lit(0))
    per = per.withColumn("full", F.col("cap") / F.col("w") <= left / left_w)
    open_words = F.sum("source_size").over(whole) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((open_words * F.col("w")) / open_w)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n") / shard_docs)).cast("long")
    return per.select("source", "k", "source_size", target.alias("target"), shards.alias("shards"))


def apportion(items: DataFrame, group: str, item: str, weight: str, total) -> DataFrame:
    """``items`` with ``seats``: ``total`` seats of each group by the highest quotients ``weight / (2 k + 1)``, ties to the first item.

    The last quotient that gets a seat lies within ``(n + 2) / total`` of its mean, n items being in the group, so only seats
    that far from the exact share are ranked: about three rows per item.
    """
    own = Window.partitionBy(group)
    share = F.col(weight) * F.col("_total") / F.sum(weight).over(own)
    spread = F.ceil(share * (F.count("*").over(own) + 2) / F.col("_total")) + 2
    some = items.withColumn("_total", total).withColumn("_share", F.when((F.col(weight) > 0) & (F.col("_total") > 0), share)).withColumn("_spread", F.when(F.col("_share").isNotNull(), spread))
    some = some.withColumn("_sure", F.when(F.col("_share").isNull(), 0).otherwise(F.greatest(F.lit(0), F.floor("_share") - F.col("_spread"))).cast("long"))
    some = some.withColumn("_open", F.col("_total") - F.sum("_sure").over(own))
    ranked = some.where("_share is not null").select(group, item, "_open", F.col(weight).alias("_w"), F.explode(F.sequence("_sure", (F.floor("_share") + F.col("_spread")).cast("long"))).alias("_k"))
    rank = F.row_number().over(own.orderBy((F.col("_w") / (2 * F.col("_k") + 1)).desc(), item, "_k"))
    won = ranked.withColumn("_rank", rank).where("_rank <= _open").groupBy(group, item).agg(F.count("*").alias("_won"))
    named = [c for c in items.columns]
    return some.join(won, [group, item], "left").select(*named, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("seats"))
