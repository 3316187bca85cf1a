"""Named queries over the test tables, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(c: str | Column, digits: int, name: str | None = None) -> Column:
    """Doubles are rounded at the query edge only, so that both engines print the same digits."""
    column = F.col(c) if isinstance(c, str) else c
    # adding zero turns -0.0 into 0.0
    out = F.round(column, digits) + F.lit(0.0)
    return out.alias(name or (c if isinstance(c, str) else "value"))
