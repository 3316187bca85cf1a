"""Missing-value imputation: fitted constants and iterated models. Observed cells and the target are never touched."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.common import numeric_columns, q, string_columns
from plumbline.operators.profile import distinct_counts, missing_counts, ranked_values
from plumbline.operators.ranks import quantile_map
from plumbline.session import materialize

STRATEGIES = ("mean", "median", "mode")
MAX_LEVELS = 100


def fit_simple(train: DataFrame, strategies: Mapping[str, str]) -> dict[str, object]:
    """Fill value per column: mean, median or mode (ties by value) of the training table."""
    unknown = set(strategies.values()) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    fills: dict[str, object] = {}
    means = [c for c, s in strategies.items() if s == "mean"]
    if means:
        row = train.agg(*[F.avg(q(c)).alias(f"_{i}") for i, c in enumerate(means)]).first()
        fills.update({c: row[f"_{i}"] for i, c in enumerate(means)})
    medians = [c for c, s in strategies.items() if s == "median"]
    fills.update({c: v[0] for c, v in quantile_map(train, medians, [0.5]).items()} if medians else {})
    modes = [c for c, s in strategies.items() if s == "mode"]
    if modes:
        fills.update({r["column"]: r["value"] for r in ranked_values(train, modes, 1).collect()})
    return fills


def apply_simple(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Fills gaps with fitted values; whole-number columns become double when the fill is not whole."""
    out = {}
    for c, value in fills.items():
        if value is None or c not in df.columns:
            continue
        kind = df.schema[c].dataType
        if isinstance(kind, T.IntegralType) and isinstance(value, float) and value != int(value):
            kind = T.DoubleType()
        out[c] = F.coalesce(q(c).cast(kind), F.lit(value).cast(kind))
    return df.withColumns(out) if out else df


def impute_iterative(
    df: DataFrame,
    key: str,
    target: str | None = None,
    rounds: int = 5,
    tolerance: float = 1e-3,
    model: str = "linear",
    seed: int = 0,
) -> DataFrame:
    """Cycles through the incomplete columns, predicting each from all others, until the fills settle.

    Starts from means and modes (chained equations, van Buuren 2011). Each round is written to the shared
    scratch folder, so the plan does not grow. Columns keep their types: fills of whole numbers are rounded. Text columns with more than ``MAX_LEVELS`` values keep their mode.
    """
    numbers = [c for c in numeric_columns(df) if c not in (key, target)]
    texts = [c for c in string_columns(df) if c not in (key, target)]
    gaps = {r["column"] for r in missing_counts(df).where(F.col("missing") < F.col("rows")).collect()}
    incomplete = [c for c in numbers + texts if c in gaps]
    if not incomplete:
        return df
    levels = {r["column"]: r["nunique"] for r in distinct_counts(df, texts, exact=False).collect()} if texts else {}
    usable = [c for c in texts if levels[c] <= MAX_LEVELS]
    start = fit_simple(df, {c: "mean" if c in numbers else "mode" for c in incomplete})
    work = df.select(
        "*",
        *[q(c).isNull().alias(f"_gap_{i}") for i, c in enumerate(incomplete)],
        *[q(c).cast("double").alias(f"_n_{c}") for c in numbers],
        *[q(c).alias(f"_s_{c}") for c in usable],
    )
    filled = {f"_n_{c}": F.coalesce(F.col(f"_n_{c}"), F.lit(float(start[c]))) for c in incomplete if c in numbers}
    filled |= {f"_s_{c}": F.coalesce(F.col(f"_s_{c}"), F.lit(start[c])) for c in incomplete if c in usable}
    empty = [c for c in numbers if c not in incomplete and _all_missing(df, c)]
    work = materialize(work.withColumns(filled).drop(*[f"_n_{c}" for c in empty]) if filled else work)
    predictors = [c for c in numbers if c not in empty]
    modelled = [(i, c) for i, c in enumerate(incomplete) if c in predictors or c in usable]
    for number in range(rounds):
        before = work
        for i, c in modelled:
            work = _predict(work, i, c, predictors, usable, model, seed + number)
        work = materialize(work)
        if _change(before, work, key, [(i, c) for i, c in modelled if c in predictors]) <= tolerance:
            break
    final = {}
    for i, c in enumerate(incomplete):
        if c in numbers:
            filling = F.col(f"_n_{c}")
            if isinstance(df.schema[c].dataType, T.IntegralType):
                filling = F.round(filling)
            final[c] = F.when(F.col(f"_gap_{i}"), filling.cast(df.schema[c].dataType)).otherwise(q(c))
        elif c in usable:
            final[c] = F.when(F.col(f"_gap_{i}"), F.col(f"_s_{c}")).otherwise(q(c))
        else:
            final[c] = F.coalesce(q(c), F.lit(start[c]))
    return work.withColumns(final).select(*df.columns)


def _all_missing(df: DataFrame, c: str) -> bool:
    return df.select(F.count(q(c))).first()[0] == 0


def _predict(work: DataFrame, i: int, c: str, numbers: Sequence[str], texts: Sequence[str], model: str, seed: int) -> DataFrame:
    """One column refitted on its observed rows and predicted on its gaps."""
    others = [f"_n_{p}" for p in numbers if p != c]
    coded = [t for t in texts if t != c]
    if not others and not coded:
        return work
    data = work
    if coded:
        indexer = StringIndexer(
            inputCols=[f"_s_{t}" for t in coded], outputCols=[f"_x_{t}" for t in coded], handleInvalid="keep"
        ).fit(data)
        data = indexer.transform(data)
    data = VectorAssembler(inputCols=others + [f"_x_{t}" for t in coded], outputCol="_features").transform(data)
    if c in texts:
        label = StringIndexer(inputCol=f"_s_{c}", outputCol="_label", handleInvalid="keep").fit(data)
        data = label.transform(data)
        fitted = RandomForestClassifier(
            featuresCol="_features", labelCol="_label", predictionCol="_guess", numTrees=10, maxBins=MAX_LEVELS + 2, seed=seed
        ).fit(data.where(~F.col(f"_gap_{i}")))
        names = F.array(*[F.lit(v) for v in label.labels])
        value = F.get(names, F.least(F.col("_guess").cast("int"), F.lit(len(label.labels) - 1)))
        column = f"_s_{c}"
    else:
        estimator = (
            LinearRegression(featuresCol="_features", labelCol=f"_n_{c}", predictionCol="_guess", regParam=1e-6)
            if model == "linear"
            else RandomForestRegressor(featuresCol="_features", labelCol=f"_n_{c}", predictionCol="_guess", numTrees=20, seed=seed)
        )
        fitted = estimator.fit(data.where(~F.col(f"_gap_{i}")))
        value = F.col("_guess")
        column = f"_n_{c}"
    predicted = fitted.transform(data)
    return predicted.withColumn(column, F.when(F.col(f"_gap_{i}"), value).otherwise(F.col(column))).select(*work.columns)


def _change(before: DataFrame, after: DataFrame, key: str, columns: Sequence[tuple[int, str]]) -> float:
    """Largest mean shift of the filled cells of a column, in standard deviations of the column."""
    if not columns:
        return 0.0
    old = before.select(q(key), *[F.col(f"_n_{c}").alias(f"_b_{i}") for i, c in columns])
    gap = reduce(lambda a, b: a | b, [F.col(f"_gap_{i}") for i, _ in columns])
    spread = after.agg(*[F.stddev_pop(f"_n_{c}").alias(f"s{i}") for i, c in columns]).first()
    moved = after.where(gap).join(old, key).agg(
        *[F.avg(F.when(F.col(f"_gap_{i}"), F.abs(F.col(f"_n_{c}") - F.col(f"_b_{i}")))).alias(f"d{i}") for i, c in columns]
    ).first()
    return max((moved[f"d{i}"] or 0.0) / (spread[f"s{i}"] or 1.0) for i, _ in columns)


def still_missing(df: DataFrame, except_for: Sequence[str] = ()) -> DataFrame:
    """Columns that still have gaps; empty after a complete imputation."""
    return missing_counts(df).where(~F.col("column").isin(*except_for)).select("column", "missing")
