"""Exact Shapley values from rankings made in the tasks of the test rows against the range-partitioned ones."""

import numpy as np
import pytest

from plumbline.operators import valuation
from plumbline.session import BROADCAST_BYTES_CONF

RNG = np.random.default_rng(23)
POINTS = {"noise": RNG.normal(size=(60, 3)), "ties": RNG.integers(0, 3, size=(60, 2)).astype("float64"), "one value": np.ones((60, 2))}


@pytest.mark.parametrize("name", POINTS)
def test_no_pair_is_written(spark, monkeypatch, name):
    rows = [(i, [float(v) for v in p], None if i % 17 == 3 else int(RNG.integers(0, 3))) for i, p in enumerate(POINTS[name])]
    rows += [(58, [0.25] * len(rows[0][1]), 1), (59, [0.5] * len(rows[0][1]), 2)]  # ids that come twice
    table = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    train, test = table.where("id < 45 or id = 58"), table.where("id >= 45 and id <> 58")
    spark.conf.set(BROADCAST_BYTES_CONF, "0")
    pairs = {r["id"]: r["value"] for r in valuation.knn_shapley(train, test, 4).collect()}
    spark.conf.unset(BROADCAST_BYTES_CONF)
    monkeypatch.setattr(valuation, "_distances", None)
    monkeypatch.setattr(valuation, "RANKED_CELLS", 100, raising=False)
    found = {r["id"]: r["value"] for r in valuation.knn_shapley(train, test, 4).collect()}
    assert found.keys() == pairs.keys()
    for i, value in pairs.items():
        assert found[i] == pytest.approx(value, abs=1e-12)
