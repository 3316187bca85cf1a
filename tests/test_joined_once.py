"""Rows that come from joins and are read several times are joined once; attribution walks go to tasks of bounded size."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import models
from plumbline.operators.balance import uniform


@pytest.fixture
def rows(spark):
    x = [uniform(seed, "id").alias(c) for seed, c in enumerate("abc", 1)]
    return spark.range(400).select("id", *x).withColumn("y", F.col("a") * 3 + F.col("b"))


@pytest.fixture
def fitted_on(monkeypatch):
    """``fitted_on(kind)`` is a list that gets, for every fit of this kind, the plan of its rows."""

    def noted(kind):
        plans, fit = [], kind.fit

        def note(self, frame, *rest):
            plans.append(frame._jdf.queryExecution().withCachedData().toString())
            return fit(self, frame, *rest)

        monkeypatch.setattr(kind, "fit", note)
        return plans

    return noted


def test_feature_selection_reads_joined_rows(rows, fitted_on):
    plans = fitted_on(models.RandomForestClassifier)
    table = rows.withColumn("late", (F.col("y") > 2).cast("string")).drop("y")
    found = {r["feature"]: r["hits"] for r in models.select_features(table, "late", "id", rounds=2).collect()}
    assert found["a"] == 2
    assert len(plans) == 2 and all("Join" not in p.split("InMemoryRelation")[0] and "InMemoryRelation" in p for p in plans)


def test_attribution_walks_in_bounded_tasks(rows, monkeypatch):
    score = lambda df: df.withColumn("score", 3 * F.col("a") + F.col("b"))
    ask = lambda: models.shapley_ranking(score, rows, "id", ["a", "b", "c"], rounds=2)
    usual = {r["feature"]: r["mean_abs_attribution"] for r in ask().collect()}
    monkeypatch.setattr(models, "WALKED_ROWS", 100, raising=False)
    made = ask()
    assert f"{400 * 2 * 4 // 100 + 1}" in [p.split()[0] for p in made._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression [id#")[1:] for p in [p.split("], ")[1]]]
    found = {r["feature"]: r["mean_abs_attribution"] for r in made.collect()}
    assert found == pytest.approx(usual) and found["a"] > found["b"] > found["c"] == 0
