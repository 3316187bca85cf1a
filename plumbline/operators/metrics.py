"""Scores of a synthetic table against the real one: sanity, fidelity and privacy.

Every metric returns rows; ``evaluate`` stacks them as ``(family, metric, value)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.special import chi2_tail
from plumbline.operators.common import constants, long_rows, melt, numeric_columns, q, string_columns, union_all
from plumbline.operators.neighbours import _parts as task_count, as_vector, ball_counts, knn, min_max
from plumbline.operators.profile import correlations
from plumbline.operators.ranks import quantile_map, running
from plumbline.operators.survival import curve_distance
from plumbline.session import materialize

CLOSE, DISTANT = 0.2, 0.8
BINS = 10
FEATURES = 512

# Metric names by family.
METRICS = {
    "sanity": (
        "data_mismatch", "common_rows_proportion", "nearest_syn_neighbor_distance", "close_values_probability",
        "distant_values_probability",
    ),
    "stats": (
        "jensenshannon_dist", "chi_squared_test", "feature_corr", "inv_kl_divergence", "ks_test", "max_mean_discrepancy",
        "wasserstein_dist", "prdc", "alpha_precision", "survival_km_distance",
    ),
    "performance": ("linear_model", "mlp", "xgb", "feat_rank_distance"),
    "privacy": ("delta-presence", "k-anonymization", "k-map", "distinct l-diversity", "identifiability_score"),
}
# (family, one-row frame, its metric columns)
Scored = tuple[str, DataFrame, Sequence[str]]

AUGMENTATION_METRICS = ("xgb_augmentation", "linear_model_augmentation", "mlp_augmentation")


# sanity


def data_mismatch(real: DataFrame, syn: DataFrame) -> DataFrame:
    """Share of real columns that are absent from the synthetic table or have another type."""
    types = dict(syn.dtypes)
    rows = [(c, kind, types.get(c), int(types.get(c) != kind)) for c, kind in real.dtypes]
    frame = constants(real, rows, ["column", "real_type", "syn_type", "differs"], ["string", "string", "string", "int"])
    return frame.agg(F.avg("differs").alias("data_mismatch"))


def common_rows(real: DataFrame, syn: DataFrame) -> DataFrame:
    """Share of real rows that occur among the synthetic rows, nulls equal. Copies collapse before the join."""
    columns = real.columns
    counted = real.groupBy(*[q(c) for c in columns]).agg(F.count("*").alias("_n"), F.lit(0).alias("_hit"))
    offered = syn.select(*[q(c) for c in columns]).distinct().withColumns({"_n": F.lit(0).cast("long"), "_hit": F.lit(1)})
    merged = counted.unionByName(offered).groupBy(*[q(c) for c in columns]).agg(
        F.sum("_n").alias("n"), F.max("_hit").alias("hit")
    )
    return merged.agg(F.try_divide(F.sum(F.col("n") * F.col("hit")), F.sum("n")).alias("common_rows_proportion"))


def _vectors(df: DataFrame, columns: Sequence[str], key: str, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(q(key).alias("id"), as_vector(columns, scale).alias("vector"))


def nearest_distances(real: DataFrame, syn: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """``(id, distance)`` from each real row to its nearest synthetic row, columns min-max scaled by the real table."""
    scale = min_max(real, columns)
    found = knn(_vectors(real, columns, key, scale), _vectors(syn, columns, key, scale), 1)
    return found.select(F.col("query_id").alias("id"), "distance")


def neighbour_sanity(real: DataFrame, syn: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Mean nearest distance and the shares of close and distant rows, from one neighbour search."""
    d = nearest_distances(real, syn, columns, key)
    return d.agg(
        F.avg("distance").alias("nearest_syn_neighbor_distance"),
        F.avg((F.col("distance") <= CLOSE).cast("double")).alias("close_values_probability"),
        F.avg((F.col("distance") >= DISTANT).cast("double")).alias("distant_values_probability"),
    )


# fidelity of the marginals


def _tagged(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    return real.select(F.lit(1).alias("_r"), *[q(c) for c in columns]).unionByName(
        syn.select(F.lit(0).alias("_r"), *[q(c) for c in columns])
    )


def binned_counts(real: DataFrame, syn: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """``(column, bin, n_real, n_syn)``: shared equal-width bins for numbers, values for text; nulls are ignored."""
    columns = list(columns if columns is not None else numeric_columns(real) + string_columns(real))
    both = _tagged(real, syn, columns)
    numbers = [c for c in columns if c in numeric_columns(real)]
    ranges = min_max(both, numbers) if numbers else {}

    def label(c: str) -> Column:
        if c not in ranges:
            return q(c).cast("string")
        low, span = ranges[c]
        if span <= 0:
            return F.when(q(c).isNotNull(), F.lit("0"))
        width = span / bins
        return F.least(F.floor((q(c).cast("double") - F.lit(low)) / F.lit(width)), F.lit(bins - 1).cast("long")).cast("string")

    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), label(c).alias("bin")) for c in columns]))
    return (
        both.select("_r", cells)
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.sum("_r").alias("n_real"), F.sum(1 - F.col("_r")).alias("n_syn"))
    )


def _with_totals(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("column").agg(
        F.sum("n_real").alias("t_real"), F.sum("n_syn").alias("t_syn"), F.count("*").alias("k")
    )
    return counts.join(F.broadcast(totals), "column")


def histogram_distances(real: DataFrame, syn: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """Per column: Jensen-Shannon distance (base 2), inverse KL divergence with add-one counts, chi-squared statistic
    with its degrees of freedom and p-value, all from one table of bin counts."""
    counts = _with_totals(binned_counts(real, syn, columns, bins))
    p, s = F.col("n_real") / F.col("t_real"), F.col("n_syn") / F.col("t_syn")
    m = (p + s) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    p1, s1 = (F.col("n_real") + 1) / (F.col("t_real") + F.col("k")), (F.col("n_syn") + 1) / (F.col("t_syn") + F.col("k"))
    total = F.col("t_real") + F.col("t_syn")
    row = F.col("n_real") + F.col("n_syn")
    expected_r, expected_s = row * F.col("t_real") / total, row * F.col("t_syn") / total
    chi = F.pow(F.col("n_real") - expected_r, 2) / expected_r + F.pow(F.col("n_syn") - expected_s, 2) / expected_s
    found = counts.groupBy("column").agg(
        F.sqrt(F.greatest(F.sum(half(p) + half(s)) / 2, F.lit(0.0))).alias("jensenshannon_dist"),
        (1 / (1 + F.sum(p1 * F.log(p1 / s1)))).alias("inv_kl_divergence"),
        F.sum(chi).alias("chi_squared"),
        (F.count("*") - 1).alias("freedom"),
    )

    @F.pandas_udf("double")
    def tail(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(float(x), int(f)) for x, f in zip(statistic, freedom)], dtype="float64")

    return found.withColumn("p_value", tail("chi_squared", "freedom"))


def distribution_distances(real: DataFrame, syn: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: ``ks_test`` as ``1 - sup |F - G|`` and ``wasserstein_dist`` as the integral of ``|F - G|``
    over the column scaled to the real range. Copies of a value collapse before anything is ordered."""
    columns = list(columns if columns is not None else numeric_columns(real))
    scale = min_max(real, columns)
    both = _tagged(real, syn, columns)
    counts = (
        melt(both, columns, ["_r"], "double").where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.sum("_r").alias("n_real"), F.sum(1 - F.col("_r")).alias("n_syn"))
    )
    steps = running(counts, ["column"], ["value"], ["n_real", "n_syn"])
    totals = counts.groupBy("column").agg(F.sum("n_real").alias("t_real"), F.sum("n_syn").alias("t_syn"))
    spans = constants(real, [(c, span if span > 0 else 1.0) for c, (_, span) in scale.items()], ["column", "span"], ["string", "double"])
    gap = F.abs(F.try_divide(F.col("cum_n_real"), F.col("t_real")) - F.try_divide(F.col("cum_n_syn"), F.col("t_syn")))
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0)) / F.col("span")
    return (
        steps.join(F.broadcast(totals), "column").join(F.broadcast(spans), "column")
        .groupBy("column")
        .agg((1 - F.max(gap)).alias("ks_test"), F.sum(gap * width).alias("wasserstein_dist"))
    )


def correlation_distance(real: DataFrame, syn: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Frobenius norm of the difference of the correlation matrices; undefined correlations count as 0."""
    columns = list(columns if columns is not None else numeric_columns(real))
    a = correlations(real, columns).select("i", "j", F.coalesce("r", F.lit(0.0)).alias("r"))
    b = correlations(syn, columns).select("i", "j", F.coalesce("r", F.lit(0.0)).alias("s"))
    squared = F.sum(F.pow(F.col("r") - F.col("s"), 2))
    return a.join(b, ["i", "j"]).agg(F.sqrt(2 * F.coalesce(squared, F.lit(0.0))).alias("feature_corr"))


# fidelity of the joint distribution


def mean_discrepancy(
    real: DataFrame, syn: DataFrame, columns: Sequence[str], gamma: float | None = None, features: int = FEATURES, seed: int = 0
) -> DataFrame:
    """Squared maximum mean discrepancy under a Gaussian kernel, by random Fourier features (Rahimi and Recht 2007).

    Each task sums its feature vectors; a pair of rows is never formed. Rows are dealt evenly to the tasks, however few
    files they come from, as each costs ``features`` sines and cosines. ``gamma`` defaults to one over the
    number of columns.
    """
    scale = min_max(real, columns)
    gamma = 1.0 / len(columns) if gamma is None else gamma
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, np.sqrt(2.0 * gamma), (len(columns), features))
    both = _tagged(real, syn, columns).repartition(task_count(real.sparkSession)).select("_r", as_vector(columns, scale).alias("vector"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for batch in batches:
            for side, part in batch.groupby("_r"):
                angle = np.stack(part["vector"].to_numpy()) @ weights
                s = np.concatenate([np.cos(angle).sum(axis=0), np.sin(angle).sum(axis=0)])
                n, old = total.get(side, (0, 0.0))
                total[side] = (n + len(part), old + s)
        for side, (n, s) in total.items():
            yield pd.DataFrame({"_r": side, "feature": np.arange(len(s)), "n": n, "s": s})

    merged = both.mapInPandas(sums, "_r int, feature int, n long, s double").groupBy("feature").agg(
        *[
            (F.sum(F.when(F.col("_r") == side, F.col("s"))) / F.sum(F.when(F.col("_r") == side, F.col("n")))).alias(f"m{side}")
            for side in (0, 1)
        ]
    )
    return merged.agg((F.sum(F.pow(F.col("m1") - F.col("m0"), 2)) / features).alias("max_mean_discrepancy"))


def prdc(real: DataFrame, syn: DataFrame, columns: Sequence[str], key: str, k: int = 5) -> DataFrame:
    """Precision, recall, density and coverage (Naeem et al. 2020) with exact neighbours and ball counts."""
    scale = min_max(real, columns)
    r, s = _vectors(real, columns, key, scale), _vectors(syn, columns, key, scale)

    def balls(frame: DataFrame) -> DataFrame:
        kth = knn(frame, frame, k, skip_same_id=True).groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("radius"))
        return materialize(frame.join(kth, "id"))

    real_balls, syn_balls = balls(r), balls(s)
    hits = ball_counts(s, real_balls, "radius").agg(F.count("*").alias("inside"), F.sum("n").alias("total"))
    back = ball_counts(r, syn_balls, "radius").agg(F.count("*").alias("inside"))
    nearest = knn(r, s, 1).select(F.col("query_id").alias("id"), "distance")
    covered = nearest.join(real_balls.select("id", "radius"), "id").agg(
        F.avg((F.col("distance") <= F.col("radius")).cast("double")).alias("coverage")
    )
    n_syn, n_real = s.agg(F.count("*").alias("n")).scalar(), r.agg(F.count("*").alias("n")).scalar()
    one = hits.select((F.col("inside") / n_syn).alias("precision"), (F.coalesce("total", F.lit(0)) / n_syn / k).alias("density"))
    return one.withColumns({"recall": back.select(F.col("inside") / n_real).scalar(), "coverage": covered.scalar()})


def alpha_precision(
    real: DataFrame, syn: DataFrame, columns: Sequence[str], key: str, steps: int = 20
) -> DataFrame:
    """Alpha-precision, beta-recall and authenticity with balls around the centroids.

    The first two are ``1 - 2 * mean |share(a) - a|`` over a grid of quantile levels; authenticity is the share of
    synthetic rows farther from their nearest real row than that row is from its nearest other real row.
    """
    scale = min_max(real, columns)
    r, s = _vectors(real, columns, key, scale), _vectors(syn, columns, key, scale)
    levels = [(i + 1) / steps for i in range(steps)]

    def coverage(inner: DataFrame, outer: DataFrame) -> Column:
        """Shares of ``outer`` within the quantile radii of ``inner`` around its centroid."""
        means = inner.agg(*[F.avg(F.get("vector", F.lit(i))).alias(f"_{i}") for i in range(len(columns))]).first()
        centre = F.array(*[F.lit(float(m)) for m in means])
        away = lambda f: f.select(
            F.sqrt(F.aggregate(F.zip_with("vector", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)).alias("d")
        )
        radii = quantile_map(away(inner), ["d"], levels)["d"]
        gaps = [F.abs(F.avg((F.col("d") <= F.lit(radius)).cast("double")) - level) for radius, level in zip(radii, levels)]
        total = gaps[0]
        for gap in gaps[1:]:
            total = total + gap
        return away(outer).agg((1 - 2 * total / len(levels)).alias("x")).scalar()

    to_real = knn(s, r, 1).select(F.col("query_id").alias("syn_id"), F.col("base_id").alias("real_id"), "distance")
    own = knn(r, r, 1, skip_same_id=True).select(F.col("query_id").alias("real_id"), F.col("distance").alias("own"))
    authentic = to_real.join(own, "real_id").agg(F.avg((F.col("distance") > F.col("own")).cast("double")).alias("authenticity"))
    return authentic.select(
        coverage(r, s).alias("alpha_precision"), coverage(s, r).alias("beta_recall"), "authenticity"
    )


def survival_km_distance(real: DataFrame, syn: DataFrame, time: str, event: Column) -> DataFrame:
    return curve_distance(real, syn, time, event).withColumnRenamed("area", "survival_km_distance")


# privacy


def buckets(df: DataFrame, columns: Sequence[str], scale: dict[str, tuple[float, float]], bins: int) -> list[Column]:
    """Quasi-identifiers for class building: numbers in equal-width buckets, other values as they are."""
    out = []
    for c in columns:
        if c in scale:
            low, span = scale[c]
            step = span / bins if span > 0 else 1.0
            out.append(F.least(F.floor((q(c).cast("double") - F.lit(low)) / F.lit(step)), F.lit(bins - 1).cast("long")).alias(c))
        else:
            out.append(q(c).alias(c))
    return out


def _classes(df: DataFrame, quasi: Sequence[str], scale, bins: int, *aggs: Column) -> DataFrame:
    keys = [f"_k{i}" for i in range(len(quasi))]
    named = [b.alias(k) for b, k in zip(buckets(df, quasi, scale, bins), keys)]
    return df.select(*named, *[q(c) for c in df.columns]).groupBy(*keys).agg(F.count("*").alias("n"), *aggs)


def _numeric_scale(df: DataFrame, quasi: Sequence[str]) -> dict[str, tuple[float, float]]:
    numbers = [c for c in quasi if c in numeric_columns(df)]
    return min_max(df, numbers) if numbers else {}


def class_privacy(df: DataFrame, quasi: Sequence[str], sensitive: str, bins: int = BINS) -> DataFrame:
    """``(k_anonymity, distinct_l_diversity)``: smallest class and fewest distinct sensitive values in a class."""
    keys = [f"_k{i}" for i in range(len(quasi))]
    scale = _numeric_scale(df, quasi)
    named = [b.alias(k) for b, k in zip(buckets(df, quasi, scale, bins), keys)]
    # one row per class and sensitive value first, so a hot class is spread over its values
    values = df.select(*named, q(sensitive).alias("_s")).groupBy(*keys, "_s").agg(F.count("*").alias("n"))
    classes = values.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("_s").alias("l"))
    return classes.agg(F.min("n").alias("k_anonymity"), F.min("l").alias("distinct_l_diversity"))


def linkage_privacy(real: DataFrame, syn: DataFrame, quasi: Sequence[str], bins: int = BINS) -> DataFrame:
    """``(delta_presence, k_map)``: largest ratio of synthetic to real rows over the classes both tables have, and the
    smallest real class that a synthetic row falls into."""
    scale = _numeric_scale(real, quasi)
    keys = [f"_k{i}" for i in range(len(quasi))]
    a = _classes(real, quasi, scale, bins).select(*keys, F.col("n").alias("n_real"), F.lit(0).cast("long").alias("n_syn"))
    b = _classes(syn, quasi, scale, bins).select(*keys, F.lit(0).cast("long").alias("n_real"), F.col("n").alias("n_syn"))
    merged = a.unionByName(b).groupBy(*keys).agg(F.sum("n_real").alias("n_real"), F.sum("n_syn").alias("n_syn"))
    hit = merged.where((F.col("n_real") > 0) & (F.col("n_syn") > 0))
    return hit.agg(
        F.max(F.col("n_syn") / F.col("n_real")).alias("delta_presence"), F.min("n_real").alias("k_map")
    )


def entropy_weights(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, float]:
    """Inverse entropy of each binned column, for the weighted distances of ``identifiability``."""
    counts = _with_totals(binned_counts(df, df.limit(0), columns, bins))
    p = F.col("n_real") / F.col("t_real")
    found = counts.groupBy("column").agg((-F.sum(p * F.log(p))).alias("h")).collect()
    return {r["column"]: 1.0 / max(r["h"], 1e-9) for r in found}


def identifiability(
    real: DataFrame, syn: DataFrame, columns: Sequence[str], key: str, weights: dict[str, float] | None = None
) -> DataFrame:
    """Share of real rows that are nearer to a synthetic row than to any other real row."""
    scale = min_max(real, columns)
    if weights is not None:
        scale = {c: (low, (span if span > 0 else 1.0) / weights.get(c, 1.0)) for c, (low, span) in scale.items()}
    r, s = _vectors(real, columns, key, scale), _vectors(syn, columns, key, scale)
    own = knn(r, r, 1, skip_same_id=True).select("query_id", F.col("distance").alias("own"))
    other = knn(r, s, 1).select("query_id", F.col("distance").alias("other"))
    nearer = (F.col("other") < F.col("own")).cast("double")
    return own.join(other, "query_id").agg(F.avg(nearer).alias("identifiability_score"))


# tables of scores


def score_table(scores: DataFrame) -> DataFrame:
    """``(generator, family, metric, mean, std, min, max, repeats)`` from ``(generator, repeat, family, metric, value)``."""
    return scores.groupBy("generator", "family", "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("repeats"),
    )


def with_ground_truth(table: DataFrame) -> DataFrame:
    """Adds the mean of generator ``gt`` beside every other generator."""
    gt = table.where(F.col("generator") == "gt").select("family", "metric", F.col("mean").alias("gt"))
    return table.where(F.col("generator") != "gt").join(F.broadcast(gt), ["family", "metric"], "left")


def evaluate(
    real: DataFrame,
    syn: DataFrame,
    key: str,
    columns: Sequence[str] | None = None,
    quasi: Sequence[str] = (),
    sensitive: str | None = None,
    time: str | None = None,
    event: str | None = None,
    k: int = 5,
) -> DataFrame:
    """``(family, metric, value)`` for all sanity, fidelity and privacy metrics that the arguments allow."""
    numbers = [c for c in (columns if columns is not None else numeric_columns(real)) if c != key]
    parts: list[Scored] = _marginal_parts(real, syn, key, numbers)
    if numbers:
        parts += [
            ("sanity", neighbour_sanity(real, syn, numbers, key), METRICS["sanity"][2:]),
            ("stats", mean_discrepancy(real, syn, numbers), ["max_mean_discrepancy"]),
            ("stats", prdc(real, syn, numbers, key, k), ["precision", "recall", "density", "coverage"]),
            ("stats", alpha_precision(real, syn, numbers, key), ["alpha_precision", "beta_recall", "authenticity"]),
            ("privacy", identifiability(real, syn, numbers, key, entropy_weights(real, numbers)), ["identifiability_score"]),
        ]
    if time is not None and event is not None:
        parts.append(("stats", survival_km_distance(real, syn, time, q(event).cast("boolean")), ["survival_km_distance"]))
    if quasi and sensitive:
        parts += [
            ("privacy", class_privacy(syn, quasi, sensitive), ["k_anonymity", "distinct_l_diversity"]),
            ("privacy", linkage_privacy(real, syn, quasi), ["delta_presence", "k_map"]),
        ]
    return _stacked(parts)


def evaluate_marginals(real: DataFrame, syn: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The part of ``evaluate`` that needs no neighbour search: a few aggregates per table."""
    numbers = [c for c in (columns if columns is not None else numeric_columns(real)) if c != key]
    return _stacked(_marginal_parts(real, syn, key, numbers))


def _marginal_parts(real: DataFrame, syn: DataFrame, key: str, numbers: Sequence[str]) -> list[Scored]:
    described = [c for c in real.columns if c != key]
    plain_real, plain_syn = real.select(*[q(c) for c in described]), syn.select(*[q(c) for c in described])
    means = ["jensenshannon_dist", "inv_kl_divergence"]
    averaged = histogram_distances(plain_real, plain_syn).agg(
        *[F.avg(m).alias(m) for m in means], F.avg("p_value").alias("chi_squared_test")
    )
    parts: list[Scored] = [
        ("sanity", data_mismatch(plain_real, plain_syn), ["data_mismatch"]),
        ("sanity", common_rows(plain_real, plain_syn), ["common_rows_proportion"]),
        ("stats", averaged, [*means, "chi_squared_test"]),
    ]
    if numbers:
        ranks = ["ks_test", "wasserstein_dist"]
        parts += [
            ("stats", correlation_distance(real, syn, numbers), ["feature_corr"]),
            ("stats", distribution_distances(real, syn, numbers).agg(*[F.avg(m).alias(m) for m in ranks]), ranks),
        ]
    return parts


def _stacked(parts: Sequence[Scored]) -> DataFrame:
    frames = []
    for family, frame, names in parts:
        rows = [(F.lit(family), F.lit(n), F.col(n).cast("double")) for n in names]
        frames.append(long_rows(frame, rows, ["family", "metric", "value"]))
    return union_all(frames)
