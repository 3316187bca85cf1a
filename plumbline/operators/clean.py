"""Cleaning steps. Decisions that depend on the data take one aggregate scan; the rest stays lazy."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.common import constants, fractional_columns, long_rows, melt, numeric_columns, q, string_columns
from plumbline.operators.profile import correlations, missing_counts
from plumbline.operators.ranks import running

HIGH_MISSING_PCT = 80.0
SMALL_SAMPLE_ROWS = 50
GLANCE_ROWS = 1000
SKETCH_VALUES = 2000  # values per column in a first look for contradictions
NUMBER = r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(nan|inf|infinity)$"
REPAIR_TYPES = ("bigint", "double", "timestamp_ntz")
# Units in which a duration can be expressed.
DURATION_UNITS = ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[q(c) for c in columns])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def column_parity(train: DataFrame, test: DataFrame) -> DataFrame:
    """``(column, found_in)`` with ``found_in`` one of both, train, test."""
    rows = [(c, "both" if c in test.columns else "train") for c in train.columns]
    rows += [(c, "test") for c in test.columns if c not in train.columns]
    return constants(train, rows, ["column", "found_in"], ["string", "string"])


def align_columns(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    common = [c for c in train.columns if c in test.columns]
    return keep_columns(train, common), keep_columns(test, common)


def sentinels_to_null(df: DataFrame, sentinels: Mapping[str, Sequence]) -> DataFrame:
    """Confirmed per-column markers, and NaN anywhere, become NULL. Nothing is assumed beyond the mapping."""
    changed: dict[str, Column] = {}
    for c in df.columns:
        value, touched = q(c), False
        if c in fractional_columns(df):
            value, touched = F.when(~F.isnan(value), value), True
        if sentinels.get(c):
            value, touched = F.when(~value.isin(*sentinels[c]), value), True
        if touched:
            changed[c] = value
    return df.withColumns(changed) if changed else df


def missing_shares(df: DataFrame) -> DataFrame:
    return missing_counts(df, only_missing=False).select("column", "pct").orderBy(F.desc("pct"), "column")


def high_missing_columns(df: DataFrame, threshold: float = HIGH_MISSING_PCT, keep: Sequence[str] = ()) -> list[str]:
    found = missing_counts(df).where(F.col("pct") >= threshold).select("column").collect()
    return [r["column"] for r in found if r["column"] not in keep]


def drop_high_missing(
    train: DataFrame, test: DataFrame | None = None, threshold: float = HIGH_MISSING_PCT, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame | None]:
    """Columns are chosen on ``train`` and dropped from both."""
    dropped = high_missing_columns(train, threshold, keep)
    return train.drop(*dropped), test.drop(*dropped) if test is not None else None


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(q(target).isNotNull())


def drop_incomplete_rows(df: DataFrame) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [q(c).isNotNull() for c in df.columns]))


def sample_size_check(df: DataFrame, minimum: int = SMALL_SAMPLE_ROWS) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("too_small", F.col("rows") < minimum)


def parses(text: Column, kind: str) -> Column:
    """Whether text reads as the type, null for null text; short digit runs are not dates."""
    parsed = F.trim(text).try_cast(kind).isNotNull()
    if kind == "double":
        # the cast also takes type suffixes: codes such as 10D or 12F are not numbers
        parsed &= F.regexp_like(F.trim(text), F.lit(NUMBER))
    if kind == "timestamp_ntz":
        parsed = (F.length(F.trim(text)) >= 8) & parsed
    return F.when(text.isNotNull(), parsed)


def possible_types(df: DataFrame, columns: Sequence[str], kinds: Sequence[str]) -> dict[str, list[str]]:
    """Types not ruled out by a glance at the first rows: one unreadable value is enough to rule a type out."""
    aggs = [
        F.coalesce(F.bool_and(parses(q(c), kind)), F.lit(True)).alias(f"_{i}_{k}")
        for i, c in enumerate(columns) for k, kind in enumerate(kinds)
    ]
    seen = df.select(*[q(c) for c in columns]).limit(GLANCE_ROWS).agg(*aggs).first()
    return {c: [kind for k, kind in enumerate(kinds) if seen[f"_{i}_{k}"]] for i, c in enumerate(columns)}


def type_suggestions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, suggested)`` for text columns whose every value parses as long, double or timestamp."""
    columns = list(columns if columns is not None else string_columns(df))
    likely = possible_types(df, columns, REPAIR_TYPES)
    aggs, rows = [], []
    for i, c in enumerate(columns):
        aggs.append(F.count(q(c)).alias(f"n{i}"))
        suggested = F.lit("string")
        for kind in reversed(likely[c]):
            aggs.append(F.bool_and(parses(q(c), kind)).alias(f"_{i}_{kind}"))
            suggested = F.when(F.col(f"_{i}_{kind}"), kind).otherwise(suggested)
        rows.append((F.lit(c), F.when(F.col(f"n{i}") == 0, "string").otherwise(suggested)))
    return long_rows(df.agg(*aggs), rows, ["column", "suggested"])


def repair_types(df: DataFrame) -> DataFrame:
    """Converts the text columns for which ``type_suggestions`` names another type."""
    if not string_columns(df):
        return df
    found = type_suggestions(df).where(F.col("suggested") != "string").collect()
    return df.withColumns({r["column"]: F.trim(q(r["column"])).try_cast(r["suggested"]) for r in found}) if found else df


def duration(start: Column, end: Column, unit: str = "DAY") -> Column:
    """Whole units from ``start`` to ``end``."""
    if unit.upper() not in DURATION_UNITS:
        raise ValueError(f"unit must be one of {DURATION_UNITS}")
    return F.timestamp_diff(unit.upper(), start, end)


def subgroups(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Long form with a ``subgroup`` column; a row appears once per condition it meets."""
    names = [F.when(condition, F.lit(name)) for name, condition in conditions.items()]
    tagged = df.withColumn("subgroup", F.explode(F.array_compact(F.array(*names))))
    return tagged


def drop_ids(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    return df.join(flagged.select(key).distinct(), key, "left_anti")


def worst_share(flagged: DataFrame, key: str, score: str, share: float) -> DataFrame:
    """The ``ceil(share * n)`` flagged ids with the highest score, ties by id."""
    scored = flagged.select(key, score, F.lit(1).alias("one"))
    n = scored.count()
    cut = math.ceil(share * n)
    ordered = running(scored.withColumn("_rank_key", -q(score)), [], ["_rank_key", key], ["one"], upper_bound=n)
    return ordered.where(F.col("cum_one") <= cut).select(key, score)


def drop_worst(df: DataFrame, flagged: DataFrame, key: str, score: str, share: float) -> DataFrame:
    return drop_ids(df, worst_share(flagged, key, score, share), key)


def identifier_columns(df: DataFrame) -> DataFrame:
    """``(column, reason)``: every value distinct (text and integer columns) or a single value throughout.

    A sketch rules out most columns; only those that may be all distinct are counted exactly.
    """
    kinds = (T.StringType, T.IntegralType)
    candidates = [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    constant = [F.coalesce(F.min(q(c)) == F.max(q(c)), F.lit(True)).alias(f"k{i}") for i, c in enumerate(df.columns)]
    first = df.agg(
        F.count("*").alias("rows"),
        *constant,
        *[F.approx_count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(candidates)],
        *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(candidates)],
    ).first()
    single = [c for i, c in enumerate(df.columns) if first[f"k{i}"]]
    # the sketch has a standard error of 5%; half the rows is far outside it
    likely = [
        c for i, c in enumerate(candidates) if first[f"n{i}"] > 1 and first[f"d{i}"] >= 0.5 * first[f"n{i}"] and c not in single
    ]
    out = constants(df, [(c, "constant") for c in single], ["column", "reason"], ["string", "string"])
    if not likely:
        return out
    repeated = (
        melt(df, likely).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
        .groupBy("column").agg(F.max("n").alias("most"))
    )
    return out.unionByName(repeated.where(F.col("most") == 1).select("column", F.lit("all values distinct").alias("reason")))


def leakage_candidates(df: DataFrame, target: str, min_correlation: float = 0.95) -> DataFrame:
    """``(column, reason)``: features almost collinear with the target, or whose repeated values fix the target.

    A value that occurs with two targets clears its column. The values of smallest hash, about ``SKETCH_VALUES`` per column with all
    their rows, clear most columns; only the cells of the others are shuffled.
    """
    features = [c for c in df.columns if c != target]
    numeric = numeric_columns(df)
    parts = []
    if target in numeric:
        pairs = correlations(df, [c for c in numeric], against=target)
        other = F.when(F.col("feature_1") == target, F.col("feature_2")).otherwise(F.col("feature_1"))
        parts.append(
            pairs.where(F.abs("r") >= min_correlation).select(other.alias("column"), F.lit("correlation").alias("reason"))
        )
    with_target = df.withColumn("_target", q(target).cast("string")).where(F.col("_target").isNotNull())

    def per_value(columns: Sequence[str], share: Mapping[str, float]) -> DataFrame:
        """Repeated values of the columns, or of the given share of each column's values by hash."""
        cells = [(c, q(c).cast("string")) for c in columns]
        low = {c: int((1 << 32) * share.get(c, 1.0)) for c in columns}
        taken = [F.struct(F.lit(c).alias("column"), F.when(F.shiftrightunsigned(F.xxhash64(v), 32) < low[c], v).alias("value")) for c, v in cells]
        found = with_target.select("_target", F.inline(F.array(*taken))).where("value is not null")
        found = found.groupBy("column", "value").agg(F.count("*").alias("n"), (F.min("_target") == F.max("_target")).alias("fixed"))
        return found.where(F.col("n") > 1)

    open_columns = features
    if features:
        sizes = df.agg(*[F.approx_count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(features)]).first()
        share = {c: min(1.0, SKETCH_VALUES / max(sizes[f"d{i}"], 1)) for i, c in enumerate(features)}
        cleared = {r["column"] for r in per_value(features, share).where("not fixed").select("column").distinct().collect()}
        open_columns = [c for c in features if c not in cleared]
    if open_columns:
        fixed = per_value(open_columns, {}).groupBy("column").agg(F.bool_and("fixed").alias("fixed")).where("fixed")
        parts.append(fixed.select("column", F.lit("determines target").alias("reason")))
    return reduce(lambda a, b: a.unionByName(b), parts, constants(df, [], ["column", "reason"], ["string", "string"]))
