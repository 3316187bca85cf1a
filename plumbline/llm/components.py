"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch

MAX_ROUNDS = 60  # the number of rounds grows with the logarithm of the longest chain


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` for every id of ``edges (a, b)``; ``component`` is the smallest id reachable.

    Null ends and loops are ignored, repeated links count once; no links give an empty table. Each round is two
    aggregations and two joins over the links and ends in a written table, so nothing is gathered anywhere and a lost
    executor costs one round at most. A much linked id is one row on the small side of each join, which Spark may split.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = scratch.keep(links)
    state = _state(links)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        links = scratch.keep(_small_star(_large_star(links)))
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each id are hung on its smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each id and its smaller neighbours are hung on the smallest of them; every link has its larger end in ``a``."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    hung = links.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
