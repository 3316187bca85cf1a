"""Column classes, null handling and reshaping shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Aggregates per job; wider tables are processed in slices to stay within code generation limits.
EXPRESSIONS_PER_AGG = 200


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer, floating and decimal columns; booleans and dates are not numbers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def fractional_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; Spark would average it, so it becomes NULL on entry."""
    nan_columns = fractional_columns(df)
    if not nan_columns:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in nan_columns})


def q(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def long_rows(df: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate into ``len(rows)`` rows without a second pass."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return df.select(F.inline(F.array(*structs)))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the result has each key once."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    other = right.select(*[q(c).alias(names.get(c, c)) for c in right.columns])
    on = [q(k).eqNullSafe(F.col(name)) for k, name in names.items()]
    joined = left.join(other, reduce(lambda x, y: x & y, on), how)
    if how in ("full_outer", "right_outer"):
        joined = joined.withColumns({k: F.coalesce(q(k), F.col(name)) for k, name in names.items()})
    return joined.drop(*names.values())


def chunks(items: Sequence, size: int) -> Iterable[Sequence]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def melt(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), as_type: str = "string") -> DataFrame:
    """``(ids..., column, value)``: one row per cell, values cast to a common type."""
    return df.select(
        *[q(c) for c in ids],
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast(as_type).alias("value")) for c in columns])),
    )


def constants(spark_df: DataFrame, rows: Sequence[Sequence], names: Sequence[str], types: Sequence[str]) -> DataFrame:
    """A small literal table (schema facts, fitted parameters), bounded by the width of the schema."""
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types))
    return spark_df.sparkSession.createDataFrame([tuple(r) for r in rows], schema)
