"""Publication-style descriptive table and the data behind its plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions.normality import shapiro_p
from plumbline.functions.probit import density_sql, probit_sql
from plumbline.functions.scalars import decimals_for_figures
from plumbline.operators.common import constants, long_rows, melt, numeric_columns, q, string_columns, union_all
from plumbline.operators.profile import detect_categoricals, value_counts
from plumbline.operators.ranks import bounded_sample, quantile_map, running
from plumbline.session import materialize

NORMALITY_ROWS = 5000
NORMALITY_P = 1e-5
NORMALITY_Z = 4.264890793922602  # beyond it lies NORMALITY_P of a normal distribution
EXPLICIT_VALUES = 5
OTHER = "Other"
BOX_WHISKER = 1.5


def partition_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(categorical, numeric) in schema order; other types belong to neither."""
    detected = detect_categoricals(df)
    text = set(string_columns(df))
    categorical = [c for c in df.columns if c in detected or c in text]
    numeric = [c for c in numeric_columns(df) if c not in detected]
    return categorical, numeric


def normality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shapiro-Francia verdict per column from all its values: ``(column, n, w, p_value, is_normal)``.

    ``w`` is the squared correlation of the ordered values with their normal scores; equal values share the mean of their scores. Its
    logarithm is normal under the hypothesis (Royston 1993), which was checked by simulation up to three million values.
    Nulls and NaN are left out. Fewer than three values are not normal, three or four are unless they differ too little to tell
    (no ``p_value``), and equal values count as normal with ``w`` 1. Infinite values are not normal.
    """
    cells = melt(df, columns, as_type="double").where("value is not null and not isnan(value)").groupBy("column", "value").agg(F.count("*").alias("n"))
    cells = materialize(cells)
    totals = cells.groupBy("column").agg(F.sum("n").alias("total"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    placed = running(cells, ["column"], ["value"], ["n"], upper_bound=cells.count()).join(F.broadcast(totals), "column")  # a row per column
    sums = scored(placed).groupBy("column").agg(F.first("total").alias("n"), F.sum("xx").alias("xx"), F.sum("xm").alias("xm"), F.sum("mm").alias("mm"), F.count("*").alias("values"))
    named = constants(df, [[c] for c in columns], ["column"], ["string"]).join(sums, "column", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    u, w = F.ln(F.col("n").cast("double")), F.col("w")
    v = F.ln(u)
    z = (F.ln(1 - w) - (-1.2725 + 1.0521 * (v - u))) / (1.0308 - 0.26758 * (v + 2 / u))
    found = named.select("column", "n", F.when(F.col("values") == 1, F.lit(1.0)).otherwise(F.try_divide(F.col("xm") * F.col("xm"), F.col("xx") * F.col("mm"))).alias("w"))
    found = found.select("column", "n", F.when((F.col("n") >= 3) & ~F.isnan("w"), F.least("w", F.lit(1.0))).alias("w"))
    tested = found.withColumn("z", F.when((F.col("n") >= 5) & (w < 1), z))
    p = F.when(F.col("n") >= 5, F.when(w >= 1, 1.0).otherwise(upper_tail("z")))
    normal = w.isNotNull() & (F.col("z").isNull() | (F.col("z") < NORMALITY_Z))
    return tested.select("column", "n", "w", p.alias("p_value"), normal.alias("is_normal"))


def scored(placed: DataFrame) -> DataFrame:
    """``(column, total, xx, xm, mm)`` per distinct value: its parts of the sums of squares and products with the normal scores.

    A value that stands alone has the score of its place; the scores of equal ones are integrated over their places.
    """
    size = F.col("total") + 0.25
    low, high = (F.col("cum_n") - F.col("n") + 0.125) / size, (F.col("cum_n") + 0.125) / size
    edges = placed.withColumns({"low": low, "high": high, "own": (F.col("cum_n") - 0.375) / size, "size": size})
    z = edges.withColumns({"a": F.expr(probit_sql("low")), "b": F.expr(probit_sql("high")), "m": F.expr(probit_sql("own"))})
    z = z.withColumns({"fa": F.expr(density_sql("a")), "fb": F.expr(density_sql("b"))})
    alone, x = F.col("n") == 1, F.col("value") - F.col("mean")
    one = F.when(alone, F.col("m")).otherwise((F.col("fa") - F.col("fb")) * F.col("size"))
    two = F.when(alone, F.col("m") * F.col("m")).otherwise((F.col("high") - F.col("b") * F.col("fb") - F.col("low") + F.col("a") * F.col("fa")) * F.col("size"))
    return z.select("column", "total", (x * x * F.col("n")).alias("xx"), (x * one).alias("xm"), two.alias("mm"))


def upper_tail(z: str) -> Column:
    """P(Z > z) of the normal distribution, one row per column of a table."""

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return pd.Series([None if v != v else 0.5 * math.erfc(v / math.sqrt(2)) for v in values.astype("float64")], dtype="float64")

    return tail(z)


def sampled_normality(df: DataFrame, columns: Sequence[str], key: str | None = None, rows: int = NORMALITY_ROWS, seed: int = 0) -> DataFrame:
    """Shapiro-Wilk verdict per column ``(column, n, p_value, is_normal)`` on at most ``rows`` sampled rows.

    The sample takes the smallest seeded hashes, so it is the same on any partitioning; what lies outside of it is not
    seen. Each group holds one column of the sample, ``rows`` values at most.
    """
    cells = [q(c).cast("double").alias(c) for c in columns]
    if key is None:
        picked = df.select(*cells, F.xxhash64(F.lit(seed), *[q(c) for c in df.columns]).alias("_h"))
        sample = picked.orderBy("_h", *[q(c) for c in columns]).limit(rows)
    else:
        sample = bounded_sample(df.select(*cells, q(key).alias("_key")), "_key", rows, seed)
    long = sample.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), q(c).alias("value")) for c in columns]))
    )

    def verdict(group: pd.DataFrame) -> pd.DataFrame:
        values = group["value"].dropna().to_numpy(dtype="float64")
        p = shapiro_p(np.sort(values)) if len(values) >= 3 else None
        return pd.DataFrame(
            {
                "column": [group["column"].iloc[0]],
                "n": [len(values)],
                "p_value": [np.nan if p is None else p],
                "is_normal": [p is not None and p > NORMALITY_P],
            }
        )

    return long.groupBy("column").applyInPandas(verdict, "column string, n long, p_value double, is_normal boolean")


def normal_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    found = {r["column"] for r in normality(df, columns).where("is_normal").collect()}
    return [c for c in columns if c in found]


def top_with_other(df: DataFrame, columns: Sequence[str], n: int = EXPLICIT_VALUES, other: str = OTHER) -> DataFrame:
    """``(column, value, n, line)``: the ``n`` largest categories, then everything else as ``other``.

    Only columns with more than ``n`` categories get the extra line, and there nulls count as ``other`` too.
    """
    counts = value_counts(df, columns)
    ordered = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = counts.withColumn("line", F.row_number().over(ordered)).where(F.col("line") <= n)
    sizes = counts.groupBy("column").agg(F.count("*").alias("categories"))
    all_rows = long_rows(
        df.agg(F.count("*").alias("rows")), [(F.lit(c), F.col("rows")) for c in columns], ["column", "rows"]
    )
    shown = top.groupBy("column").agg(F.sum("n").alias("shown"))
    rest = (
        all_rows.join(sizes.where(F.col("categories") > n), "column")
        .join(shown, "column")
        .select("column", F.lit(other).alias("value"), (F.col("rows") - F.col("shown")).alias("n"), F.lit(n + 1).alias("line"))
    )
    return top.select("column", "value", "n", "line").unionByName(rest)


def category_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, line, variable, summary)``: a header with an empty summary, then ``count/total (pct)`` lines."""
    wide = df.agg(*[F.count(q(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    totals = long_rows(wide, [(F.lit(c), F.col(f"_{i}")) for i, c in enumerate(columns)], ["column", "total"])
    body = (
        top_with_other(df, columns)
        .join(F.broadcast(totals), "column")
        .select(
            "column",
            "line",
            F.format_string("<<%s>> %s", "column", "value").alias("variable"),
            F.format_string(
                "%d/%d (%s)", "n", "total", fixed(F.col("n") / F.col("total") * 100, F.lit(1))
            ).alias("summary"),
        )
    )
    header = constants(
        df, [(c, 0, c, "") for c in columns], ["column", "line", "variable", "summary"], ["string", "int", "string", "string"]
    )
    return header.unionByName(body)


def fixed(value: Column, places: Column) -> Column:
    """Text of ``value`` with a per-row number of decimals, rounding the exact binary value."""
    return F.translate(F.call_function("format_number", value, places), ",", "")


def numeric_lines(df: DataFrame, normal: Sequence[str], other: Sequence[str]) -> DataFrame:
    """``mean ± std`` for normal columns and ``median (Q1 - Q3)`` for the rest."""
    names = ["column", "line", "variable", "summary"]
    parts = []
    if normal:
        wide = df.agg(
            *[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(normal)],
            *[F.stddev_samp(q(c).cast("double")).alias(f"s{i}") for i, c in enumerate(normal)],
        )
        long = long_rows(
            wide, [(F.lit(c), F.col(f"m{i}"), F.col(f"s{i}")) for i, c in enumerate(normal)], ["column", "m", "s"]
        ).withColumn("d", decimals_for_figures(F.col("m")))
        text = F.concat(fixed(F.col("m"), F.col("d")), F.lit(" ± "), fixed(F.col("s"), F.col("d")))
        parts.append(long.select("column", F.lit(0).alias("line"), F.col("column").alias("variable"), text.alias("summary")))
    if other:
        found = quantile_map(df, other, [0.25, 0.5, 0.75])
        rows = [(c, *found[c]) for c in other]
        long = constants(df, rows, ["column", "q1", "m", "q3"], ["string", "double", "double", "double"])
        long = long.withColumn("d", decimals_for_figures(F.col("m")))
        text = F.concat(
            fixed(F.col("m"), F.col("d")), F.lit(" ("), fixed(F.col("q1"), F.col("d")),
            F.lit(" - "), fixed(F.col("q3"), F.col("d")), F.lit(")"),
        )
        parts.append(long.select("column", F.lit(0).alias("line"), F.col("column").alias("variable"), text.alias("summary")))
    if not parts:
        return constants(df, [], names, ["string", "int", "string", "string"])
    return union_all(parts)


def table_one(df: DataFrame, normal: Sequence[str] | None = None, key: str | None = None) -> DataFrame:
    """``(position, line, variable, summary)`` in column order. ``normal`` overrides the normality test."""
    categorical, numeric = partition_columns(df)
    is_normal = normal_columns(df, numeric) if normal is None else [c for c in numeric if c in set(normal)]
    parts = [numeric_lines(df, is_normal, [c for c in numeric if c not in is_normal])]
    if categorical:
        parts.append(category_lines(df, categorical))
    order = constants(df, [(i, c) for i, c in enumerate(df.columns)], ["position", "column"], ["int", "string"])
    return union_all(parts).join(F.broadcast(order), "column").select("position", "line", "variable", "summary")


def for_print(table: DataFrame) -> DataFrame:
    """Drops the ``<<column>>`` marker of sub-lines, leaving an indent."""
    return table.withColumn("variable", F.regexp_replace("variable", "<<.*?>>", "   "))


def bar_data(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return value_counts(df, columns)


def histogram_data(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, bin, lower, upper, n)`` with the finer of the Sturges and Freedman-Diaconis widths."""
    wide = df.agg(
        *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.min(q(c)).cast("double").alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(q(c)).cast("double").alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    quartiles = quantile_map(df, columns, [0.25, 0.75])
    plan = []
    for i, c in enumerate(columns):
        n, low, high = wide[f"n{i}"], wide[f"a{i}"], wide[f"b{i}"]
        if n:
            plan.append((c, low, high, bin_count(n, low, high, *quartiles[c])))
    cells = F.inline(
        F.array(
            *[
                F.when(
                    q(c).isNotNull(),
                    F.struct(F.lit(c).alias("column"), bin_of(q(c).cast("double"), low, high, bins).alias("bin")),
                )
                for c, low, high, bins in plan
            ]
        )
    )
    counts = df.select(cells).where("column is not null").groupBy("column", "bin").agg(F.count("*").alias("n"))
    widths = constants(
        df, [(c, low, (high - low) / bins) for c, low, high, bins in plan], ["column", "low", "width"], ["string", "double", "double"]
    )
    return counts.join(F.broadcast(widths), "column").select(
        "column", "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("lower"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper"), "n",
    )


def bin_count(n: int, low: float, high: float, q1: float, q3: float) -> int:
    sturges = int(np.ceil(np.log2(n) + 1))
    width = 2 * (q3 - q1) / n ** (1 / 3)
    freedman = int(np.ceil((high - low) / width)) if width > 0 else 1
    return max(1, sturges, freedman)


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Index of an equal-width bin; the top edge belongs to the last bin."""
    if high <= low:
        return F.lit(0).cast("long")
    return F.least(F.floor((value - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1).cast("long"))


def box_data(df: DataFrame, columns: Sequence[str], whisker: float = BOX_WHISKER) -> DataFrame:
    """``(column, q1, median, q3, whisker_low, whisker_high, fliers)``: whiskers end at the last cell in range."""
    found = {c: v for c, v in quantile_map(df, columns, [0.25, 0.5, 0.75]).items() if v[0] is not None}
    aggs, rows = [], []
    for i, (c, (q1, q2, q3)) in enumerate(found.items()):
        v, reach = q(c).cast("double"), whisker * (q3 - q1)
        inside = v.between(F.lit(q1 - reach), F.lit(q3 + reach))
        aggs += [
            F.min(F.when(inside, v)).alias(f"a{i}"), F.max(F.when(inside, v)).alias(f"b{i}"),
            F.count_if(~inside).alias(f"f{i}"),
        ]
        rows.append((F.lit(c), F.lit(q1), F.lit(q2), F.lit(q3), F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"f{i}")))
    names = ["column", "q1", "median", "q3", "whisker_low", "whisker_high", "fliers"]
    return long_rows(df.agg(*aggs), rows, names)
