"""Kaplan-Meier curves and the distance between two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.common import join_on, q
from plumbline.operators.ranks import running


def kaplan_meier(df: DataFrame, time: str, event: Column, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., time, at_risk, events, censored, survival)`` at every observed time.

    Rows collapse to one per time before anything is ordered; the product of ``1 - d/n`` is a running sum of
    logarithms, and survival is 0 from the time on at which everyone at risk has the event.
    """
    group = [q(b) for b in by]
    known = df.where(q(time).isNotNull() & event.isNotNull())
    times = known.groupBy(*group, q(time).alias("time")).agg(
        F.count_if(event).alias("events"), F.count_if(~event).alias("censored"), F.count("*").alias("n")
    )
    return _survival(times, list(by))


def _survival(times: DataFrame, by: list[str]) -> DataFrame:
    """From ``(by, time, events, censored, n)``, one row per time, to the curve."""
    counted = running(times, by, ["time"], ["n"]).drop("next_time")
    totals = times.groupBy(*by).agg(F.sum("n").alias("total"))
    at_risk = (F.col("total") - F.col("cum_n") + F.col("n")).alias("at_risk")
    if by:
        joined = join_on(counted, totals, by)
    else:
        joined = counted.withColumn("total", times.agg(F.sum("n").alias("total")).scalar())
    died_out = F.col("events") >= F.col("at_risk")
    steps = joined.select(*by, "time", "events", "censored", at_risk).withColumns(
        {
            "term": F.when(died_out, 0.0).otherwise(F.log1p(-F.col("events") / F.col("at_risk"))),
            "over": F.when(died_out & (F.col("events") > 0), 1).otherwise(0),
        }
    )
    curve = running(steps, by, ["time"], ["term", "over"])
    survival = F.when(F.col("cum_over") > 0, 0.0).otherwise(F.exp("cum_term"))
    return curve.select(*by, "time", "at_risk", "events", "censored", survival.alias("survival"))


def curve_distance(first: DataFrame, second: DataFrame, time: str, event: Column) -> DataFrame:
    """One row ``(area)``: area between the two survival curves over the union of their times."""
    def counts(frame: DataFrame, side: int) -> DataFrame:
        known = frame.where(q(time).isNotNull() & event.isNotNull())
        grouped = known.groupBy(q(time).alias("time")).agg(F.count_if(event).alias("d"), F.count("*").alias("n"))
        zero = F.lit(0).cast("long")
        pick = {1: ("d", "n", zero, zero), 2: (zero, zero, "d", "n")}[side]
        return grouped.select("time", *[(F.col(c) if isinstance(c, str) else c).alias(a) for c, a in zip(pick, ("d1", "n1", "d2", "n2"))])

    times = (
        counts(first, 1).unionByName(counts(second, 2)).groupBy("time")
        .agg(*[F.sum(c).alias(c) for c in ("d1", "n1", "d2", "n2")])
    )
    totals = times.agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2")).first()
    counted = running(times, [], ["time"], ["n1", "n2"]).drop("next_time")
    terms = {}
    for s in ("1", "2"):
        at_risk = F.lit(totals[f"t{s}"]) - F.col(f"cum_n{s}") + F.col(f"n{s}")
        died_out = (F.col(f"d{s}") > 0) & (F.col(f"d{s}") >= at_risk)
        terms[f"term{s}"] = F.when(died_out | (F.col(f"d{s}") == 0), 0.0).otherwise(F.log1p(-F.col(f"d{s}") / at_risk))
        terms[f"over{s}"] = F.when(died_out, 1).otherwise(0)
    steps = counted.withColumns(terms).select("time", *terms)
    curve = running(steps, [], ["time"], list(terms))

    def level(s: str) -> Column:
        return F.when(F.col(f"cum_over{s}") > 0, 0.0).otherwise(F.exp(f"cum_term{s}"))

    width = F.coalesce(F.col("next_time") - F.col("time"), F.lit(0))
    return curve.agg(F.sum(F.abs(level("1") - level("2")) * width).alias("area"))


def censoring_weights(df: DataFrame, time: str, event: Column) -> DataFrame:
    """``(time, weight)``: one over the chance of not being censored before each observed time.

    The chance is the Kaplan-Meier curve of the censoring times just before the time. Events come before censorings of the same time,
    so they are no longer at risk of these. Rows without time or event are left out.
    """
    known = df.where(q(time).isNotNull() & event.isNotNull())
    times = known.groupBy(q(time).alias("time")).agg(F.count_if(event).alias("d"), F.count_if(~event).alias("c"), F.count("*").alias("n"))
    counted = running(times, [], ["time"], ["n"]).drop("next_time")
    at_risk = F.lit(times.agg(F.sum("n")).first()[0]) - F.col("cum_n") + F.col("n") - F.col("d")
    # where the last ones at risk are censored no time follows, so that step never enters a weight
    term = F.when((F.col("c") == 0) | (F.col("c") >= at_risk), 0.0).otherwise(F.log1p(-F.col("c") / at_risk))
    curve = running(counted.select("time", term.alias("term")), [], ["time"], ["term"])
    return curve.select("time", F.exp(F.col("term") - F.col("cum_term")).alias("weight"))
