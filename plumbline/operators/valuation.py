"""Rows that do not fit, and what each training row is worth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.common import numeric_columns, q, union_all
from plumbline.operators.neighbours import BASE_SLICE, _distance, _id_type, _matrix, _pair_distances, _parts, _squared, knn
from plumbline.operators.profile import OUTLIER_FACTOR, outlier_bounds, outside
from plumbline.operators.ranks import quantile_map, running
from plumbline.session import broadcast_bytes, materialize

HELD_BUDGETS = 4  # broadcast budgets that the training rows may take where whole rankings are made in tasks
RANKED_CELLS = 4_000_000  # distances that a task ranks at a time


def iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, factor: float = OUTLIER_FACTOR
) -> tuple[DataFrame, DataFrame]:
    """``(clean, outliers)``: a row is an outlier when any numeric cell lies outside its column's fences."""
    columns = list(columns if columns is not None else numeric_columns(df))
    bounds = outlier_bounds(df, columns, factor)
    flags = [F.coalesce(outside(c, b), F.lit(False)) for c, b in bounds.items() if b is not None]
    if not flags:
        return df, df.limit(0)
    flag = reduce(lambda a, b: a | b, flags)
    return df.where(~flag), df.where(flag)


def knn_outliers(df: DataFrame, share: float, k: int = 5, id_col: str = "id", vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """``(clean, outliers)``: rows whose distance to their ``k``-th neighbour is above the ``1 - share`` quantile."""
    # written, as the quantile and both results pass over the distances and would each search again
    found = knn(df, df, k, id_col, vector, skip_same_id=True).groupBy("query_id").agg(F.max("distance").alias("_reach"))
    reach = materialize(found).withColumnRenamed("query_id", id_col)
    limit = quantile_map(reach, ["_reach"], [1.0 - share])["_reach"][0]
    far = reach.where(F.col("_reach") > F.lit(limit)).select(id_col)
    return df.join(far, id_col, "left_anti"), df.join(far, id_col, "left_semi")


def knn_shapley(
    train: DataFrame, test: DataFrame, k: int = 10, id_col: str = "id", vector: str = "vector", label: str = "label"
) -> DataFrame:
    """``(id, value)``: exact k-nearest-neighbour Shapley value of each training row, averaged over the test rows.

    By definition every training row is ranked for every test row. With ``m(i)`` whether the labels agree
    and ``r`` the rank, the recurrence of Jia et al. (2019) unrolls to
    ``s(r) = m(r) / max(k, r) - sum over j > max(r, k) of m(j) / (j (j - 1))``, which needs one ranking and one
    running sum. Training rows of up to ``HELD_BUDGETS`` broadcast budgets are shipped to the tasks of the test rows, which rank them
    for a few test rows at a time and only add up: no pair is written, and the work is that of all pairs. Beyond, rankings are
    range-partitioned, so no task sees a whole one, and every pair is written.
    Use ``knn_shapley_within`` when a bounded error will do: it only looks at the nearest rows.
    """
    kind, label_kind = _id_type(train, id_col), train.schema[label].dataType.simpleString()
    t = train.select(q(id_col).alias("id"), q(vector).cast("array<double>").alias("v"), q(label).alias("y"))
    s = test.select(q(id_col).alias("id"), q(vector).cast("array<double>").alias("v"), q(label).alias("y"))
    width = s.select(F.size("v").alias("d")).first()
    if width is None:
        raise ValueError("no test rows")
    n_test, n_train = s.count(), t.count()
    cell = 4 if train.schema[vector].dataType == T.ArrayType(T.FloatType()) else 8
    if n_train * (cell * max(width["d"], 1) + 16) <= HELD_BUDGETS * broadcast_bytes(train.sparkSession):
        return _ranked_in_tasks(t, s, k, kind, cell).groupBy("id").agg((F.sum("v") / F.lit(n_test)).alias("value"))
    # the test side travels in slices that each fit the broadcast budget
    slices = min(n_test, -(-n_test * (width["d"] + 2) * 8 // max(broadcast_bytes(train.sparkSession), 1)))
    rankings = [_distances(t, s, i, slices, kind, label_kind) for i in range(slices)]
    pairs = union_all(rankings).withColumn("one", F.lit(1))
    bound = n_test * n_train
    ranked = running(pairs, ["test_id"], ["distance", "id"], ["one"], bound).select(
        "test_id", "id", "same", F.col("cum_one").alias("r")
    )
    tail = F.when((F.col("r") > k) & F.col("same"), 1.0 / (F.col("r") * (F.col("r") - 1))).otherwise(0.0)
    summed = running(ranked.withColumn("tail", tail), ["test_id"], ["r"], ["tail"], bound)
    totals = ranked.where((F.col("r") > k) & F.col("same")).groupBy("test_id").agg(
        F.sum(1.0 / (F.col("r") * (F.col("r") - 1))).alias("total")
    )
    own = F.when(F.col("same"), 1.0 / F.greatest(F.col("r"), F.lit(k))).otherwise(0.0)
    value = own - (F.coalesce("total", F.lit(0.0)) - F.col("cum_tail"))
    return summed.join(totals, "test_id", "left").groupBy("id").agg((F.sum(value) / F.lit(n_test)).alias("value"))


def _ranked_in_tasks(t: DataFrame, s: DataFrame, k: int, kind: str, cell: int) -> DataFrame:
    """``(id, v)``: per task the sum of each training row's value over the task's test rows; test rows that share an id share a ranking."""
    spark = t.sparkSession
    local = t.toPandas()
    if local.empty:
        return spark.createDataFrame([], f"id {kind}, v double")
    ties = pd.factorize(local["id"], sort=True)[0]  # equal distances are ordered by id, null first
    shared = spark.sparkContext.broadcast((local["id"].to_numpy(), ties, _matrix(local["v"]).astype(f"float{8 * cell}"), local["y"].to_numpy()))
    del local

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, ties, rows, labels = shared.value
        total, any_row = np.zeros(len(ids)), False
        some = max(1, RANKED_CELLS // len(ids))
        for batch in batches:
            vectors = np.array([v for own in batch["v"] for v in own], dtype="float64").reshape(-1, rows.shape[1])
            truth = [y for own in batch["y"] for y in own]
            ends = np.cumsum([len(own) for own in batch["y"]])
            start = 0
            while start < len(ends):
                stop = start + 1
                first = ends[start - 1] if start else 0
                while stop < len(ends) and ends[stop] - first <= some:
                    stop += 1
                d, slack = _all_squared(vectors[first : ends[stop - 1]], rows)
                for group in range(start, stop):
                    own = np.arange(ends[group - 1] if group else 0, ends[group])
                    _add_values(total, d[own - first], slack, vectors[own], [truth[i] for i in own], rows, labels, ties, k)
                any_row, start = True, stop
        if any_row:
            yield pd.DataFrame({"id": ids, "v": total})

    grouped = s.repartition(_parts(spark), "id").groupBy("id").agg(F.collect_list(F.struct("v", "y")).alias("_rows"))
    return grouped.select(F.col("_rows")["v"].alias("v"), F.col("_rows")["y"].alias("y")).mapInPandas(add_up, f"id {kind}, v double")


def _all_squared(some: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    out, slack = np.empty((len(some), len(rows))), 0.0
    for at in range(0, len(rows), BASE_SLICE):
        out[:, at : at + BASE_SLICE], bound = _squared(some, rows[at : at + BASE_SLICE].astype("float64"))
        slack = max(slack, bound) if bound == bound else np.inf
    return out, slack


def _add_values(total, d, slack: float, vectors, truth: list, rows, labels, ties, k: int) -> None:
    """Adds the values of all rows for the test rows of one id; rows whose rounded distances may be in disorder are put right."""
    n = len(rows)
    flat = d.ravel()
    order = np.argsort(flat)
    with np.errstate(invalid="ignore"):
        close = ~(np.diff(flat[order]) > 2 * slack)
    near = np.r_[False, close] | np.r_[close, False]
    if near.any():
        own = order[near]
        exact = _pair_distances(vectors, own // n, rows, own % n)
        order[near] = own[np.lexsort((ties[own % n], exact, np.cumsum(np.r_[True, ~close])[near]))]
    same = np.concatenate([np.zeros(n, bool) if y is None else np.asarray(labels == y, bool) for y in truth])[order]
    r = np.arange(1.0, len(order) + 1)
    tail = np.zeros(len(r))
    tail[k:] = same[k:] / (r[k:] * np.maximum(r[k:] - 1, 1))
    value = same / np.maximum(r, k) - (tail.sum() - np.cumsum(tail))
    if len(truth) == 1:
        total[order] += value
    else:
        np.add.at(total, order % n, value)


def _distances(t: DataFrame, s: DataFrame, number: int, slices: int, kind: str, label_kind: str) -> DataFrame:
    part = s.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == number).toPandas()
    shared = t.sparkSession.sparkContext.broadcast((part["id"].to_numpy(), _matrix(part["v"]), part["y"].to_numpy()))

    def rank_inputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, labels = shared.value
        for batch in batches:
            rows, own = _matrix(batch["v"]), batch["y"].to_numpy()
            for i in range(len(ids)):
                yield pd.DataFrame(
                    {"test_id": ids[i], "id": batch["id"], "distance": _distance(rows, vectors[i]), "same": own == labels[i]}
                )

    spread = t.repartition(max(t.sparkSession.sparkContext.defaultParallelism, 1), "id")
    return spread.mapInPandas(rank_inputs, f"test_id {kind}, id {kind}, distance double, same boolean")


def knn_shapley_within(
    train: DataFrame, test: DataFrame, k: int, error: float, id_col: str = "id", vector: str = "vector", label: str = "label"
) -> DataFrame:
    """``(id, value)`` within ``error`` of the exact value (Jia et al. 2019, theorem 2).

    Only the ``max(k, ceil(1 / error))`` nearest training rows of a test row get a value, so an exact
    neighbour search replaces the full ranking; rows that are never that near are worth 0.
    """
    depth = max(k, int(np.ceil(1.0 / error)))
    n_test = test.count()
    near = knn(test, train, depth, id_col, vector).withColumnsRenamed({"query_id": "test_id", "base_id": "id"})
    labels = train.select(q(id_col).alias("id"), q(label).alias("train_y"))
    asked = test.select(q(id_col).alias("test_id"), q(label).alias("test_y"))
    matched = near.join(labels, "id").join(asked, "test_id").withColumn("same", F.col("train_y") == F.col("test_y"))
    # at most ``depth`` entries per test row, so the inner sum is bounded; the last rank carries value 0
    per_test = matched.groupBy("test_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "same"))).alias("near"))
    term = lambda e: F.when(e["same"], 1.0).otherwise(0.0)
    inner = F.transform(
        F.sequence(F.lit(1), F.size("near") - 1),
        lambda i: (term(F.element_at("near", i)) - term(F.element_at("near", i + 1))) / F.greatest(i, F.lit(k)),
    )
    steps = per_test.where(F.size("near") > 1).select(
        "near",
        F.reverse(
            F.aggregate(
                F.reverse(inner), F.array(F.lit(0.0)), lambda acc, x: F.array_append(acc, F.element_at(acc, F.lit(-1)) + x)
            )
        ).alias("values"),
    )
    cells = steps.select(F.inline(F.zip_with("near", "values", lambda e, v: F.struct(e["id"].alias("id"), v.alias("v")))))
    summed = cells.groupBy("id").agg(F.sum("v").alias("v"))
    everyone = train.select(q(id_col).alias("id"))
    return everyone.join(summed, "id", "left").select("id", (F.coalesce("v", F.lit(0.0)) / F.lit(n_test)).alias("value"))
