"""Outliers by nearest neighbours search once, however often their distances are passed over."""

import numpy as np

from plumbline.operators import neighbours, valuation


def test_searched_once(spark, monkeypatch):
    searched, best = spark.sparkContext.accumulator(0), neighbours._top_k

    def noted(k, skip_same_id):
        kernel = best(k, skip_same_id)

        def kernel_noted(q_ids, *rest):
            searched.add(len(q_ids))
            return kernel(q_ids, *rest)

        return kernel_noted

    monkeypatch.setattr(neighbours, "_top_k", noted)
    points = np.random.default_rng(3).normal(size=(60, 2))
    points[:3] += [[40, 0], [0, 60], [-80, 0]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    clean, far = valuation.knn_outliers(spark.createDataFrame(rows, "id long, vector array<double>"), 0.05, 5)
    assert sorted(r["id"] for r in far.collect()) == [0, 1, 2]
    assert sorted(r["id"] for r in clean.collect()) == list(range(3, 60))
    assert searched.value == 60
