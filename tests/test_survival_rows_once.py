"""A survival study works out the rows behind its tables once, whatever is fitted and scored on them."""

from pyspark.sql import functions as F

from plumbline.operators import models


def test_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    costly = F.udf(count, "double").asNondeterministic()

    def rows(start, stop):
        cells = "id", "cast(id % 11 as double) as x", "1 + (id * 37) % 29 + 2 * (id % 11) as days", "cast(id % 4 > 0 as int) as event"
        return spark.range(start, stop).selectExpr(*cells).withColumn("x", costly("x"))

    study = models.survival_study(rows(0, 300), rows(300, 400), "days", "event", exclude=["id"])
    assert study.scores.first()["metric"] == "concordance"
    assert seen.value == 400
