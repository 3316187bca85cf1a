"""Order statistics without a single-task sort.

``running`` gives running totals over an ordered column. Groups proven small by a count use a plain
window; larger ones are range-partitioned, totalled per range and shifted by the totals of the ranges
before them, so no task ever holds a whole group. ``quantiles`` brackets each quantile with a
rank sketch and counts exactly inside the bracket only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.operators.common import EXPRESSIONS_PER_AGG, chunks, constants, join_on, long_rows, melt, q, union_all
from plumbline.session import materialize, small_rows

# Up to this many cells the built-in exact percentile, which merges all distinct values in one task, is the cheaper way.
BUILTIN_CELLS = 1_000_000
# More quantiles than this come from a full ranking instead of brackets.
FEW_QUANTILES = 10
# Sketches of this size are off by about 0.07 percent of the ranks; brackets reach three times as far.
SKETCH_SIZE = 8192
SKETCH_REACH = 0.002


def running(
    df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str], upper_bound: int | None = None
) -> DataFrame:
    """Adds ``cum_<s>`` (inclusive running sum) per ``by`` group and ``next_<order[0]>``.

    ``order`` must be unique within a group. ``upper_bound`` is a row count already known to the caller.
    """
    spark = df.sparkSession
    limit = small_rows(spark)
    rows = df.count() if upper_bound is None else upper_bound
    lead = f"next_{order[0]}"
    if rows <= limit:
        ordered = W.partitionBy(*by).orderBy(*order) if by else W.partitionBy(F.lit(0)).orderBy(*order)
        upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns(
            {**{f"cum_{s}": F.sum(s).over(upto) for s in sums}, lead: F.lead(order[0]).over(ordered)}
        )

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 1_000_000 + 1)
    ranged = materialize(
        df.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id())
    )
    totals = ranged.groupBy(*by, "_range").agg(
        *[F.sum(s).alias(f"_t_{s}") for s in sums], F.min(order[0]).alias("_first")
    )
    between = W.partitionBy(*by).orderBy("_range") if by else W.partitionBy(F.lit(0)).orderBy("_range")
    before = between.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        F.lead("_first").over(between).alias("_next_first"),
    )
    inside = W.partitionBy(*by, "_range").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    shifted = ranged.withColumns(
        {**{f"_c_{s}": F.sum(s).over(upto) for s in sums}, "_lead": F.lead(order[0]).over(inside)}
    )
    shifted = join_on(shifted, offsets, [*by, "_range"])
    return shifted.select(
        *[q(c) for c in df.columns],
        *[(F.col(f"_c_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        F.coalesce("_lead", "_next_first").alias(lead),
    )


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles as ``(column, prob, value)``; nulls are ignored.

    Small tables use the built-in aggregate. A few quantiles of a large one are bracketed by sketches, a long grid
    of them comes from one distributed ranking of the distinct values.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    if not columns:
        return constants(df, [], ["column", "prob", "value"], ["string", "double", "double"])
    counted = df.agg(F.count("*").alias("rows"), *[F.count(q(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    rows, present = counted["rows"], list(counted)[1:]
    if rows <= small_rows(df.sparkSession) and rows * len(columns) <= BUILTIN_CELLS:
        return union_all([_builtin_quantiles(df, part, probs) for part in chunks(columns, EXPRESSIONS_PER_AGG)])
    return _bracketed_quantiles(df, columns, probs, present) if len(probs) <= FEW_QUANTILES else _ranked_quantiles(df, columns, probs)


def _builtin_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    wide = df.agg(*[F.percentile(q(c).cast("double"), wanted).alias(f"_{i}") for i, c in enumerate(columns)])
    # an all-null column yields no array; it still gets its rows
    none = F.array_repeat(F.lit(None).cast("double"), len(probs))
    rows = [(F.lit(c), F.coalesce(F.col(f"_{i}"), none)) for i, c in enumerate(columns)]
    per_column = long_rows(wide, rows, ["column", "values"])
    return per_column.select("column", F.inline(F.arrays_zip(wanted.alias("prob"), F.col("values").alias("value")))).toDF(
        "column", "prob", "value"
    )


@dataclass
class _Bracket:
    """A quantile that is known to lie in ``[low, high]``, with ``below`` smaller values and ``inside`` values there."""

    column: int
    prob: float
    position: float
    low: float
    high: float
    below: int
    inside: int

    def holds(self, value: Column) -> Column:
        return (value >= F.lit(self.low)) & (value <= F.lit(self.high))

    def covers(self, low_count: int, up_to_count: int) -> bool:
        """Ranks are zero-based; both neighbours of the position must lie between the counts."""
        return low_count <= math.floor(self.position) and math.ceil(self.position) < up_to_count


def _bracketed_quantiles(df: DataFrame, columns: list[str], probs: list[float], present: list[int]) -> DataFrame:
    """Selection by brackets: mergeable rank sketches of one scan propose a narrow bracket per quantile, a counting scan accepts those
    that certainly hold their target, and only the values inside are ranked. The result does not depend on the sketches: a bracket that
    fails the count stays the whole column.
    """
    values = [q(c).cast("double") for c in columns]
    brackets = [
        _Bracket(i, p, p * (present[i] - 1), -math.inf, math.inf, 0, present[i])
        for i in range(len(columns)) if present[i] for p in probs
    ]
    for part in chunks(brackets, EXPRESSIONS_PER_AGG // 2):
        _narrow(df, values, list(part))
    settled = constants(
        df,
        [(columns[b.column], b.prob, b.low) for b in brackets if b.low == b.high]
        + [(columns[i], p, None) for i in range(len(columns)) if not present[i] for p in probs],
        ["column", "prob", "value"], ["string", "double", "double"],
    )
    open_ones = [(k, b) for k, b in enumerate(brackets) if b.low < b.high]
    if not open_ones:
        return settled
    inside = [b.holds(values[b.column]) for _, b in open_ones]
    cells = [
        F.when(hit, F.struct(F.lit(k).alias("k"), values[b.column].alias("v"))) for hit, (k, b) in zip(inside, open_ones)
    ]
    # most rows lie in no bracket and are dropped before they are taken apart
    counts = (
        df.where(reduce(lambda x, y: x | y, inside)).select(F.inline(F.array(*cells))).where("k is not null")
        .groupBy("k", "v").agg(F.count("*").alias("n"))
    )
    target = constants(
        df, [(k, columns[b.column], b.prob, b.position - b.below) for k, b in open_ones],
        ["k", "column", "prob", "position"], ["int", "string", "double", "double"],
    )
    return settled.unionByName(_picked(running(materialize(counts), ["k"], ["v"], ["n"]), target, ["k"]))


def _narrow(df: DataFrame, values: list[Column], brackets: list[_Bracket]) -> None:
    """One scan of sketches and one of counts; brackets that pass the count are replaced in place."""
    own: dict[int, list[_Bracket]] = {}
    for b in brackets:
        own.setdefault(b.column, []).append(b)

    def ends(b: _Bracket) -> list[Column]:
        return [F.lit(max(b.prob - SKETCH_REACH, 0.0)), F.lit(min(b.prob + SKETCH_REACH, 1.0))]

    sketches = df.agg(*[F.kll_sketch_agg_double(values[c], SKETCH_SIZE).alias(f"_{c}") for c in own])
    proposed = sketches.select(*[F.kll_sketch_get_quantile_double(F.col(f"_{c}"), F.array(*[e for b in some for e in ends(b)])).alias(f"_{c}") for c, some in own.items()]).first()
    checks, open_ones = [], []
    for c, some in own.items():
        for k, b in enumerate(some):
            low, high = proposed[f"_{c}"][2 * k : 2 * k + 2] if proposed[f"_{c}"] else (None, None)
            if low is not None and high is not None:
                at = len(open_ones)
                open_ones.append((b, low, high))
                checks += [F.count_if(values[c] < F.lit(low)).alias(f"b{at}"), F.count_if(values[c] <= F.lit(high)).alias(f"u{at}")]
    counted = df.agg(*checks).first() if checks else None
    for at, (b, low, high) in enumerate(open_ones):
        if b.covers(counted[f"b{at}"], counted[f"u{at}"]):
            b.low, b.high, b.below, b.inside = low, high, counted[f"b{at}"], counted[f"u{at}"] - counted[f"b{at}"]


def _ranked_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """All quantiles of a long grid from one ranking of the distinct values per column."""
    counts = materialize(
        melt(df, columns, as_type="double").where("value is not null")
        .groupBy("column", F.col("value").alias("v")).agg(F.count("*").alias("n"))
    )
    sizes = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    empty = constants(
        df, [(c, p, None) for c in columns if c not in sizes for p in probs], ["column", "prob", "value"], ["string", "double", "double"]
    )
    # ranks are cut into as many stretches as grid points; a value meets only the grid points of the stretches its own ranks lie in
    step = {c: max(n // len(probs), 1) for c, n in sizes.items()}
    steps = constants(df, list(step.items()), ["column", "step"], ["string", "long"])
    grid = [(c, p, p * (n - 1)) for c, n in sizes.items() for p in probs]
    target = constants(
        df, [(c, p, at, rank, rank // step[c]) for c, p, at in grid for rank in {math.floor(at), math.ceil(at)}],
        ["column", "prob", "position", "rank", "stretch"], ["string", "double", "double", "long", "long"],
    )
    ordered = running(counts, ["column"], ["v"], ["n"]).join(F.broadcast(steps), "column")
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    placed = ordered.withColumn("stretch", F.explode(F.sequence(F.floor(first / F.col("step")), F.floor(last / F.col("step")))))
    hits = placed.join(F.broadcast(target), ["column", "stretch"]).where(F.col("rank").between(first, last))
    return _interpolated(hits, ["column", "prob"]).unionByName(empty)


def _picked(ordered: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    return _interpolated(ordered.join(F.broadcast(target), keys), [*keys, "column", "prob"])


def _interpolated(hits: DataFrame, keys: list[str]) -> DataFrame:
    """From values with running counts and a position each to the value at the position."""
    first, last, at = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1, F.col("position")
    return (
        hits.groupBy(*keys)
        .agg(
            F.max(F.when(F.floor(at).between(first, last), F.col("v"))).alias("lo"),
            F.max(F.when(F.ceil(at).between(first, last), F.col("v"))).alias("hi"),
            F.max(at - F.floor(at)).alias("w"),
        )
        .select("column", "prob", (F.col("lo") + F.col("w") * (F.col("hi") - F.col("lo"))).alias("value"))
    )


def quantile_map(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles on the driver: one number per column and probability."""
    found = {(r["column"], r["prob"]): r["value"] for r in quantiles(df, columns, probs).collect()}
    return {c: [found.get((c, float(p))) for p in probs] for c in columns}


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """The ``rows`` rows with the smallest seeded hash of ``key``: same rows on any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), q(key)), q(key)).limit(rows)


