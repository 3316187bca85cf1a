"""A study predicts each test row once per candidate, however many metrics it is scored by."""

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from plumbline.operators import models


class Constant:
    def __init__(self, seen):
        self.seen = seen

    def transform(self, df):
        seen = self.seen

        def said(label):
            seen.add(1)
            return 0.0

        predict = F.udf(said, "double").asNondeterministic()
        chances = F.udf(lambda label: Vectors.dense([0.75, 0.25]), VectorUDT())
        return df.withColumn(models.PREDICTION, predict(models.LABEL)).withColumn(models.PROBABILITY, chances(models.LABEL))


def test_test_rows_are_predicted_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(models, "_fit", lambda *_: (Constant(seen), None))
    df = spark.range(300).selectExpr("id", "cast(id % 7 as double) as x", "if(id % 3 = 0, 'a', 'b') as y")
    study = models.classification_study(df.where("id >= 90"), df.where("id < 90"), "y", exclude=["id"], folds=0, candidates=["linear_model"])
    found = {r["metric"]: r["value"] for r in study.scores.collect()}
    assert found["accuracy"] == 30 / 90 and found["auc"] == 0.5
    assert seen.value == 90
