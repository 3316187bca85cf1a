"""Dataset profile: shape, moments, quantiles, categories, missing cells, correlation, outliers, duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from plumbline.operators.common import (
    EXPRESSIONS_PER_AGG,
    chunks,
    constants,
    long_rows,
    melt,
    numeric_columns,
    q,
    string_columns,
    union_all,
)
from plumbline.operators.ranks import quantile_map, quantiles

MAX_CATEGORIES = 20
MAX_CATEGORY_RATIO = 0.05
OUTLIER_FACTOR = 1.75
TOP_VALUES = 5
TOP_PAIRS = 10
# Above this estimate a column certainly has more than MAX_CATEGORIES distinct values.
SURELY_MANY = 100
GRAM_WIDTH = 4


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> DataFrame:
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return constants(df, rows, ["position", "column", "type"], ["int", "string", "string"])


SUMS = ("n", "mean", "min", "max", "s1", "s2", "s3", "s4")


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, count, mean, std, min, max, skew, kurt)`` from two scans: the means, then plain power sums around them.

    Sums around the mean are exact to rounding wherever the values lie, in whatever order they come. Skewness and kurtosis are
    bias-corrected; a constant column gives 0.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    if not columns:
        names = ["column", "count", "mean", "std", "min", "max", "skew", "kurt"]
        return constants(df, [], names, ["string"] + ["double"] * 7)
    parts = []
    for part in chunks(list(enumerate(columns)), EXPRESSIONS_PER_AGG // 4):
        value = {i: q(c).cast("double") for i, c in part}
        first = df.agg(*[f(v).alias(f"{n}{i}") for i, v in value.items() for n, f in (("n", F.count), ("m", F.avg), ("a", F.min), ("b", F.max))]).first()
        off = {i: v - F.lit(first[f"m{i}"] if first[f"m{i}"] is not None else 0.0) for i, v in value.items()}
        powers = {i: [d, d * d, d * d * d, (d * d) * (d * d)] for i, d in off.items()}
        wide = df.agg(*[F.sum(x).alias(f"s{k + 1}_{i}") for i, own in powers.items() for k, x in enumerate(own)])
        known = lambda i, name: F.lit(first[f"{name}{i}"]).cast("double")
        rows = [(F.lit(c), *[known(i, n) for n in "nmab"], *[F.col(f"s{k}_{i}") for k in (1, 2, 3, 4)]) for i, c in part]
        parts.append(long_rows(wide, rows, ["column", *SUMS]))
    n, flat = F.col("n"), F.col("min") == F.col("max")
    # the mean of the first scan is rounded; d is what it is off by
    d = F.try_divide(F.col("s1"), n)
    m2 = F.col("s2") - n * d * d
    m3 = F.col("s3") - 3 * d * F.col("s2") + 2 * n * d * d * d
    m4 = F.col("s4") - 4 * d * F.col("s3") + 6 * d * d * F.col("s2") - 3 * n * d * d * d * d
    central = union_all(parts).withColumns({"_m2": m2, "_m3": m3, "_m4": m4})
    spread = F.try_divide(F.col("_m2"), n)
    shaped = central.withColumns(
        {"std": F.sqrt(F.try_divide(F.col("_m2"), n - 1)), "skew": F.try_divide(F.col("_m3") / n, spread * F.sqrt(spread)), "kurt": F.try_divide(F.col("_m4") / n, spread * spread) - 3}
    )
    n, flat = F.col("n"), F.col("min") == F.col("max")
    skew = F.when(n < 3, None).when(flat, 0.0).otherwise(F.col("skew") * F.try_divide(F.sqrt(n * (n - 1)), n - 2))
    kurt = F.when(n < 4, None).when(flat, 0.0).otherwise(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("kurt") + 6))
    std = F.when(n >= 2, F.when(flat, 0.0).otherwise(F.col("std")))
    return shaped.select("column", n.alias("count"), "mean", std.alias("std"), "min", "max", skew.alias("skew"), kurt.alias("kurt"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``moments`` with the quartiles."""
    columns = list(columns if columns is not None else numeric_columns(df))
    quartiles = (
        quantiles(df, columns, [0.25, 0.5, 0.75])
        .groupBy("column")
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in _QUARTILES])
    )
    return moments(df, columns).join(F.broadcast(quartiles), "column")


_QUARTILES = (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))


def _typed_counts(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """``(column, value, n)`` per storage class, so that numbers are grouped as numbers and not as text."""
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kind = df.schema[c].dataType
        name = "bigint" if isinstance(kind, T.IntegralType) else "double" if isinstance(kind, (T.FloatType, T.DoubleType)) else "string"
        kinds.setdefault(name, []).append(c)
    return [
        melt(df, group, as_type=name).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
        for name, group in kinds.items()
    ]


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` over all non-null cells; values as text."""
    return union_all([counts.withColumn("value", F.col("value").cast("string")) for counts in _typed_counts(df, columns)])


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-null values per column: one row per column."""
    columns = list(columns if columns is not None else df.columns)
    if exact:
        named = constants(df, [(c,) for c in columns], ["column"], ["string"])
        seen = union_all([c.groupBy("column").agg(F.count("*").alias("nunique")) for c in _typed_counts(df, columns)])
        return named.join(seen, "column", "left").select("column", F.coalesce("nunique", F.lit(0)).alias("nunique"))
    wide = df.agg(*[F.approx_count_distinct(q(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    return long_rows(wide, [(F.lit(c), F.col(f"_{i}")) for i, c in enumerate(columns)], ["column", "nunique"])


def ranked_values(df: DataFrame, columns: Sequence[str], n: int = TOP_VALUES) -> DataFrame:
    """The ``n`` most frequent values per column, ties by value; the rank filter runs before the shuffle."""
    ordered = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return value_counts(df, columns).withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= n)


def rare_values(df: DataFrame, columns: Sequence[str], n: int = TOP_VALUES) -> DataFrame:
    """The last ``n`` values of the same ranking, only for columns with more than ``n`` distinct values."""
    counts = value_counts(df, columns)
    many = counts.groupBy("column").agg(F.count("*").alias("nunique")).where(F.col("nunique") > n)
    ordered = W.partitionBy("column").orderBy(F.asc("n"), F.desc("value"))
    last = counts.withColumn("rank_from_end", F.row_number().over(ordered)).where(F.col("rank_from_end") <= n)
    return last.join(F.broadcast(many.select("column")), "column", "left_semi")


def category_check(df: DataFrame, max_values: int = MAX_CATEGORIES, max_ratio: float = MAX_CATEGORY_RATIO) -> DataFrame:
    """``(column, all_integral, nunique, rows, is_categorical)`` for every numeric column."""
    columns = numeric_columns(df)
    wide = df.agg(
        F.count("*").alias("rows"),
        *[F.coalesce(F.bool_and(_integral(c)), F.lit(True)).alias(f"i{k}") for k, c in enumerate(columns)],
    )
    integral = long_rows(
        wide,
        [(F.lit(c), F.col(f"i{k}"), F.col("rows")) for k, c in enumerate(columns)],
        ["column", "all_integral", "rows"],
    )
    few = F.col("nunique") <= F.least(F.lit(float(max_values)), F.lit(max_ratio) * F.col("rows"))
    return integral.join(distinct_counts(df, columns), "column").select(
        "column", "all_integral", "nunique", "rows", (F.col("all_integral") & few).alias("is_categorical")
    )


def _integral(c: str) -> Column:
    return q(c) == F.floor(q(c))


def detect_categoricals(
    df: DataFrame, max_values: int = MAX_CATEGORIES, max_ratio: float = MAX_CATEGORY_RATIO
) -> dict[str, list]:
    """Numeric columns that are really categories, with their sorted values.

    Two scans, no shuffle of values: a sketch rules out wide columns, then the few that are left have
    at most about ``SURELY_MANY`` values, so collecting their sets is bounded.
    """
    columns = numeric_columns(df)
    if not columns:
        return {}
    first = df.agg(
        F.count("*").alias("rows"),
        *[F.coalesce(F.bool_and(_integral(c)), F.lit(True)).alias(f"i{k}") for k, c in enumerate(columns)],
        *[F.approx_count_distinct(q(c)).alias(f"d{k}") for k, c in enumerate(columns)],
    ).first()
    limit = min(max_values, max_ratio * first["rows"])
    likely = [
        c for k, c in enumerate(columns) if first[f"i{k}"] and first[f"d{k}"] <= max(SURELY_MANY, 5 * max_values)
    ]
    if not likely:
        return {}
    sets = df.agg(*[F.array_sort(F.collect_set(q(c))).alias(f"s{k}") for k, c in enumerate(likely)]).first()
    return {c: sets[f"s{k}"] for k, c in enumerate(likely) if len(sets[f"s{k}"]) <= limit}


def encode_categories(df: DataFrame, categories: dict[str, list]) -> DataFrame:
    """Replace each listed column by the index of its value among the sorted values; null becomes -1."""
    encoded = {}
    for c, values in categories.items():
        kind = dict(df.dtypes)[c]
        if not values:
            encoded[c] = F.lit(-1)
            continue
        position = F.array_position(F.array(*[F.lit(v).cast(kind) for v in values]), q(c))
        encoded[c] = (F.coalesce(position, F.lit(0)) - 1).cast("int")
    return df.withColumns(encoded) if encoded else df


def missing_counts(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """``(column, missing, rows, pct)`` in one scan."""
    wide = df.agg(
        F.count("*").alias("rows"), *[F.count_if(q(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)]
    )
    names = ["column", "missing", "rows"]
    out = long_rows(wide, [(F.lit(c), F.col(f"_{i}"), F.col("rows")) for i, c in enumerate(df.columns)], names)
    out = out.withColumn("pct", F.try_divide(F.col("missing") * 100.0, F.col("rows")))
    return out.where(F.col("missing") > 0) if only_missing else out


def missing_rows(df: DataFrame) -> DataFrame:
    """One row: rows with any missing cell, their share, rows with every cell missing, columns all missing."""
    absent = [q(c).isNull() for c in df.columns]
    wide = df.agg(
        F.count("*").alias("rows"),
        F.count_if(reduce(lambda a, b: a | b, absent)).alias("rows_any_missing"),
        F.count_if(reduce(lambda a, b: a & b, absent)).alias("rows_all_missing"),
        *[F.count(q(c)).alias(f"_{i}") for i, c in enumerate(df.columns)],
    )
    empty = reduce(lambda a, b: a + b, [(F.col(f"_{i}") == 0).cast("int") for i in range(len(df.columns))])
    return wide.select(
        "rows",
        "rows_any_missing",
        F.try_divide(F.col("rows_any_missing") * 100.0, F.col("rows")).alias("pct_any_missing"),
        "rows_all_missing",
        empty.alias("columns_all_missing"),
    )


def empty_columns(df: DataFrame) -> DataFrame:
    return missing_counts(df).where(F.col("missing") == F.col("rows")).select("column", "rows")


def correlations(df: DataFrame, columns: Sequence[str] | None = None, against: str | None = None) -> DataFrame:
    """Pearson correlation of every unordered pair ``(i, j, feature_1, feature_2, r)``, pairwise complete.

    With ``against`` only the pairs that include that column. A constant side gives null. Narrow tables use JVM aggregates; wide ones add up block products per batch.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    names = ["i", "j", "feature_1", "feature_2", "r"]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    pairs = [(i, j) for i, j in pairs if against is None or against in (columns[i], columns[j])]
    if not pairs:
        return constants(df, [], names, ["int", "int", "string", "string", "double"])
    if len(columns) > GRAM_WIDTH:
        return _gram_correlations(df, columns, pairs)
    v = [q(c).cast("double") for c in columns]
    parts = []
    for part in chunks(pairs, EXPRESSIONS_PER_AGG // 4):
        aggs = []
        for i, j in part:
            a, b = F.when(v[j].isNotNull(), v[i]), F.when(v[i].isNotNull(), v[j])
            aggs += [
                F.covar_pop(v[i], v[j]).alias(f"c{i}_{j}"),
                F.stddev_pop(a).alias(f"a{i}_{j}"),
                F.stddev_pop(b).alias(f"b{i}_{j}"),
                (F.min(a) == F.max(a)).alias(f"p{i}_{j}"),
                (F.min(b) == F.max(b)).alias(f"q{i}_{j}"),
            ]
        rows = []
        for i, j in part:
            r = F.try_divide(F.col(f"c{i}_{j}"), F.col(f"a{i}_{j}") * F.col(f"b{i}_{j}"))
            r = F.when(F.col(f"p{i}_{j}") | F.col(f"q{i}_{j}"), None).otherwise(r)
            rows.append((F.lit(i), F.lit(j), F.lit(columns[i]), F.lit(columns[j]), r))
        parts.append(long_rows(df.agg(*aggs), rows, names))
    return union_all(parts)


def _gram_correlations(df: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """Per batch: X'X, X'M, (X*X)'M and M'M for values X and presence mask M; sums are merged by Spark."""
    centre = df.agg(*[F.avg(q(c).cast("double")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    means = np.array([m if m is not None else 0.0 for m in centre], dtype="float64")
    upper_i, upper_j = np.array(pairs).T

    def block_sums(batches):
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype="float64", na_value=np.nan) - means
            present = ~np.isnan(x)
            m = present.astype("float64")
            x = np.where(present, x, 0.0)
            with_mask, squares = x.T @ m, (x * x).T @ m
            part = np.stack([m.T @ m, with_mask, with_mask.T, squares, squares.T, x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            n, sx, sy, sxx, syy, sxy = total[:, upper_i, upper_j]
            yield pd.DataFrame(
                {"i": upper_i, "j": upper_j, "n": n, "sx": sx, "sy": sy, "sxx": sxx, "syy": syy, "sxy": sxy}
            )

    cells = df.select(*[q(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    sums = cells.mapInPandas(
        block_sums, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    )
    total = sums.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    var_x = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    var_y = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    # cancellation leaves a residue of this size for a constant side
    flat = (var_x <= F.col("sxx") * 1e-14) | (var_y <= F.col("syy") * 1e-14)
    r = F.when(flat, None).otherwise(F.try_divide(cov, F.sqrt(F.abs(var_x) * F.abs(var_y))))
    names = constants(df, list(enumerate(columns)), ["k", "name"], ["int", "string"])
    first = F.broadcast(names.select(F.col("k").alias("i"), F.col("name").alias("feature_1")))
    second = F.broadcast(names.select(F.col("k").alias("j"), F.col("name").alias("feature_2")))
    return total.withColumn("r", r).join(first, "i").join(second, "j").select("i", "j", "feature_1", "feature_2", "r")


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, n: int = TOP_PAIRS) -> DataFrame:
    """The ``n`` strongest positive and the ``n`` strongest negative pairs."""
    signed = (
        correlations(df, columns)
        .where(F.col("r").isNotNull() & (F.col("r") != 0))
        .withColumn("sign", F.when(F.col("r") > 0, "positive").otherwise("negative"))
    )
    ordered = W.partitionBy("sign").orderBy(F.desc(F.abs("r")), "i", "j")
    return (
        signed.withColumn("rank", F.row_number().over(ordered))
        .where(F.col("rank") <= n)
        .select("sign", "rank", "feature_1", "feature_2", "r")
    )


def correlogram(
    df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None, n: int = TOP_PAIRS
) -> DataFrame:
    """Correlation matrix (lower triangle) of the features behind the ``n`` largest distinct ``|r|``.

    Equal values collapse to one pair before the cut, the self-correlation 1.0 is skipped, and a
    numeric target is always included. The matrix is as large as the schema squared, not the data.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    pairs = correlations(df, columns).where(F.col("r").isNotNull())
    magnitude = F.abs("r")
    # the largest distinct magnitude is the self-correlation; an exact |r| = 1 collapses into it
    per_value = (
        pairs.where(magnitude < 1.0)
        .groupBy(magnitude.alias("magnitude"))
        .agg(F.min(F.struct("i", "j", "feature_1", "feature_2")).alias("pair"))
        .orderBy(F.desc("magnitude"))
        .limit(n)
    )
    chosen = per_value.select(F.explode(F.array("pair.feature_1", "pair.feature_2")).alias("feature"))
    if target is not None and target in columns:
        chosen = chosen.unionByName(constants(df, [(target,)], ["feature"], ["string"]))
    chosen = F.broadcast(chosen.distinct())
    return (
        pairs.join(chosen.withColumnRenamed("feature", "feature_1"), "feature_1", "left_semi")
        .join(chosen.withColumnRenamed("feature", "feature_2"), "feature_2", "left_semi")
        .select("feature_1", "feature_2", "r")
    )


def outlier_bounds(
    df: DataFrame, columns: Sequence[str] | None = None, factor: float = OUTLIER_FACTOR
) -> dict[str, tuple[float, float] | None]:
    columns = list(columns if columns is not None else numeric_columns(df))
    bounds: dict[str, tuple[float, float] | None] = {}
    for c, (low, high) in quantile_map(df, columns, [0.25, 0.75]).items():
        bounds[c] = None if low is None else (low - factor * (high - low), high + factor * (high - low))
    return bounds


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None, factor: float = OUTLIER_FACTOR) -> DataFrame:
    """``(column, lower, upper, outliers)``: cells strictly outside the quartile fences."""
    columns = list(columns if columns is not None else numeric_columns(df))
    names = ["column", "lower", "upper", "outliers"]
    if not columns:
        return constants(df, [], names, ["string", "double", "double", "long"])
    bounds = outlier_bounds(df, columns, factor)
    wide = df.agg(
        *[
            (F.count_if(outside(c, bounds[c])) if bounds[c] else F.lit(0).cast("long")).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = [
        (
            F.lit(c),
            F.lit(bounds[c][0] if bounds[c] else None).cast("double"),
            F.lit(bounds[c][1] if bounds[c] else None).cast("double"),
            F.col(f"_{i}"),
        )
        for i, c in enumerate(columns)
    ]
    return long_rows(wide, rows, names)


def outside(c: str, bounds: tuple[float, float]) -> Column:
    value = q(c).cast("double")
    return (value < bounds[0]) | (value > bounds[1])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat another row, nulls equal. Copies collapse map-side before the shuffle."""
    groups = df.groupBy(*[q(c) for c in df.columns]).agg(F.count("*").alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Counts and shares of the target; nulls are their own class."""
    counts = df.groupBy(q(target).alias("class")).agg(F.count("*").alias("n"))
    rows = df.agg(F.count("*").alias("rows")).scalar()
    return counts.withColumn("share", F.col("n") / rows)


def report(df: DataFrame, target: str | None = None) -> DataFrame:
    """The whole profile as one long table ``(section, column, stat, value)``; values as text.

    Detected categories are replaced by codes before correlation, outliers and duplicates are computed.
    """
    categories = detect_categoricals(df)
    coded = encode_categories(df, categories)
    textual = [c for c in df.columns if c in categories or c in string_columns(df)]

    def block(section: str, frame: DataFrame, column: Column, stats: Sequence[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("string").alias("value")) for s in stats])
        return frame.select(F.lit(section).alias("section"), column.alias("column"), F.inline(cells))

    everything = F.lit("*")
    parts = [
        block("shape", shape(df), everything, ["rows", "columns"]),
        block("types", column_types(df), F.col("column"), ["type"]),
        block("missing", missing_counts(df), F.col("column"), ["missing", "pct"]),
        block("missing_rows", missing_rows(df), everything, ["rows_any_missing", "rows_all_missing"]),
        block("duplicates", duplicate_rows(coded), everything, ["duplicates"]),
        constants(df, [("detected_category", c, "values", str(len(v))) for c, v in categories.items()],
                  ["section", "column", "stat", "value"], ["string"] * 4),
    ]
    if numeric_columns(df):
        stats = ["count", "mean", "std", "min", "q25", "q50", "q75", "max", "skew", "kurt"]
        pair = F.concat_ws(" ~ ", "feature_1", "feature_2")
        parts += [
            block("numeric", describe(df), F.col("column"), stats),
            block("outliers", outlier_counts(coded), F.col("column"), ["lower", "upper", "outliers"]),
            block("correlation", top_correlations(coded), pair, ["r"]),
            block("correlogram", correlogram(coded, target), pair, ["r"]),
        ]
    if textual:
        top = ranked_values(df, textual).select("column", F.col("value").alias("stat"), F.col("n").cast("string").alias("value"))
        rare = rare_values(df, textual).select("column", F.col("value").alias("stat"), F.col("n").cast("string").alias("value"))
        parts += [
            block("distinct", distinct_counts(df, textual), F.col("column"), ["nunique"]),
            top.select(F.lit("top_values").alias("section"), "column", "stat", "value"),
            rare.select(F.lit("rare_values").alias("section"), "column", "stat", "value"),
        ]
    if target is not None:
        parts.append(
            class_distribution(df, target).select(
                F.lit("target").alias("section"),
                F.lit(target).alias("column"),
                F.col("class").cast("string").alias("stat"),
                F.col("n").cast("string").alias("value"),
            )
        )
    return union_all(parts)


def report_text(report_frame: DataFrame) -> str:
    """Text rendering of a collected report; its size depends on the schema only."""
    lines: list[str] = []
    section = None
    for row in report_frame.collect():
        if row["section"] != section:
            section = row["section"]
            lines.append(f"\n[{section}]")
        lines.append(f"{row['column']}  {row['stat']}: {row['value']}")
    return "\n".join(lines).strip()


