"""Merging files on keys, with the checks around it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.common import constants, long_rows, q
from plumbline.session import materialize


def merge(left: DataFrame, right: DataFrame, on: Sequence[str], renames: Mapping[str, str] | None = None) -> DataFrame:
    """Inner join on the key columns after renaming matched columns of ``right``.

    Join strategy, broadcast and skew splitting are left to the planner.
    """
    return left.join(right.withColumnsRenamed(dict(renames or {})), on=list(on), how="inner")


def merge_report(inputs: Sequence[DataFrame], merged: DataFrame) -> DataFrame:
    """``(column, rows_largest_input, rows_merged, rows_lost, nulls_before, nulls_after)`` per merged column."""
    counted = [
        frame.agg(F.count("*").alias("rows"), *[F.count_if(q(c).isNull()).alias(f"_{i}") for i, c in enumerate(frame.columns)])
        for frame in inputs
    ]
    before = None
    for frame, wide in zip(inputs, counted):
        part = long_rows(wide, [(F.lit(c), F.col(f"_{i}"), F.col("rows")) for i, c in enumerate(frame.columns)],
                         ["column", "nulls_before", "rows_input"])
        before = part if before is None else before.unionByName(part)
    largest = before.agg(F.max("rows_input").alias("m")).scalar()
    nulls = before.groupBy("column").agg(F.sum("nulls_before").alias("nulls_before"))
    after = long_rows(
        merged.agg(F.count("*").alias("rows"), *[F.count_if(q(c).isNull()).alias(f"_{i}") for i, c in enumerate(merged.columns)]),
        [(F.lit(c), F.col(f"_{i}"), F.col("rows")) for i, c in enumerate(merged.columns)],
        ["column", "nulls_after", "rows_merged"],
    )
    joined = after.join(F.broadcast(nulls), "column", "left").withColumn("rows_largest_input", largest)
    return joined.select(
        "column", "rows_largest_input", "rows_merged",
        (F.col("rows_largest_input") - F.col("rows_merged")).alias("rows_lost"),
        F.coalesce("nulls_before", F.lit(0)).alias("nulls_before"), "nulls_after",
    )


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*[q(k) for k in keys]).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(rows, distinct_keys, largest_group, is_unique)`` of a key or combination."""
    return (
        df.groupBy(*[q(k) for k in keys])
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count("*").alias("distinct_keys"),
            F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"),
        )
        .withColumn("is_unique", F.col("largest_group") <= 1)
    )


def _plain_name(c) -> F.Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


WORD_BITS = 62  # columns that share one whole number of flags


def match_columns(left: DataFrame, right: DataFrame, kinds_must_match: bool = True) -> DataFrame:
    """``(left_column, right_column, name_score, overlap, score)`` ranked pairs of columns that may hold the same thing.

    ``overlap`` is the exact Jaccard index of the distinct values, compared as text. Columns without a partner of their kind are not
    read. Each value is shuffled once with a bit for every column that holds it, combined before the shuffle.
    """
    kinds = [{_kind(t) for _, t in frame.dtypes} for frame in (left, right)]
    sides = [[c for c, t in frame.dtypes if not kinds_must_match or _kind(t) in kinds[1 - i]] for i, frame in enumerate((left, right))]
    bits = {(i, c): k for k, (i, c) in enumerate((i, c) for i in (0, 1) for c in sides[i])}
    words = -(-max(len(bits), 1) // WORD_BITS)

    def values(frame: DataFrame, side: int) -> DataFrame:
        cells = [
            F.struct(q(c).cast("string").alias("value"), *[F.lit(1 << k % WORD_BITS if k // WORD_BITS == w else 0).cast("long").alias(f"m{w}") for w in range(words)])
            for c in sides[side]
            for k in [bits[side, c]]
        ]
        return frame.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())

    masks = [f"m{w}" for w in range(words)]
    if all(sides):
        seen = values(left, 0).unionByName(values(right, 1)).groupBy("value").agg(*[F.bit_or(m).alias(m) for m in masks])
        holders = materialize(seen.groupBy(*masks).agg(F.count("*").alias("n")))
    else:
        holders = constants(left, [], [*masks, "n"], ["long"] * (words + 1))

    def held(side: int, name: str) -> Column:
        return F.array_compact(
            F.array(F.lit(None).cast("string"), *[F.when(F.col(f"m{k // WORD_BITS}").bitwiseAND(F.lit(1 << k % WORD_BITS)) != 0, F.lit(c)) for (i, c), k in bits.items() if i == side])
        ).alias(name)

    sets = holders.select(held(0, "ls"), held(1, "rs"), "n")
    total = F.sum("n").alias
    left_n = sets.select(F.explode("ls").alias("l"), "n").groupBy("l").agg(total("nl"))
    right_n = sets.select(F.explode("rs").alias("r"), "n").groupBy("r").agg(total("nr"))
    both = sets.select(F.explode("ls").alias("l"), "rs", "n").select("l", F.explode("rs").alias("r"), "n").groupBy("l", "r").agg(total("shared"))
    pairs = constants(
        left,
        [(a, b, ka, kb) for a, ka in left.dtypes for b, kb in right.dtypes if not kinds_must_match or _kind(ka) == _kind(kb)],
        ["l", "r", "lk", "rk"],
        ["string"] * 4,
    )
    a, b = _plain_name(F.col("l")), _plain_name(F.col("r"))
    longest = F.greatest(F.length(a), F.length(b))
    shared = F.coalesce("shared", F.lit(0))
    union = F.coalesce("nl", F.lit(0)) + F.coalesce("nr", F.lit(0)) - shared
    scored = (
        pairs.join(both, ["l", "r"], "left").join(left_n, "l", "left").join(right_n, "r", "left")
        .select(
            F.col("l").alias("left_column"), F.col("r").alias("right_column"),
            F.coalesce(1 - F.try_divide(F.levenshtein(a, b), longest), F.lit(0.0)).alias("name_score"),
            F.coalesce(F.try_divide(shared, union), F.lit(0.0)).alias("overlap"),
        )
    )
    return scored.withColumn("score", (F.col("name_score") + F.col("overlap")) / 2)


def _kind(type_name: str) -> str:
    whole = ("tinyint", "smallint", "int", "bigint")
    return "number" if type_name in whole or type_name in ("float", "double") or type_name.startswith("decimal") else type_name
