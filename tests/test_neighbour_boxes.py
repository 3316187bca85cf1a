"""Narrow vectors are cut into boxes: exact results, and a query meets few rows however many there are."""

import numpy as np
import pytest

from plumbline.functions import boxes
from plumbline.operators import metrics, neighbours
from plumbline.session import BROADCAST_BYTES_CONF

RNG = np.random.default_rng(23)


def lines(n):
    """A column of few values beside one of many, as nations and balances are."""
    return np.column_stack([RNG.integers(0, 25, n) / 24, RNG.random(n)])


def brute(points, codes, rows, row_codes, k, skip):
    out = []
    for i, p in enumerate(points):
        d = np.sqrt(((rows - p) ** 2).sum(axis=1))
        d[skip & (row_codes == codes[i])] = np.inf
        best = np.lexsort((row_codes, d))[:k]
        out += [(i, int(row_codes[j]), float(d[j])) for j in best if np.isfinite(d[j])]
    return out


@pytest.mark.parametrize("skip", [True, False])
@pytest.mark.parametrize("k", [1, 5, 90])
@pytest.mark.parametrize("pairs", [60, 400_000])
def test_nearest_rows_and_balls_in_boxes(monkeypatch, skip, k, pairs):
    monkeypatch.setattr(boxes, "PAIRS", pairs)
    for rows in (lines(300), RNG.integers(0, 4, (300, 3)).astype("float64"), np.repeat(RNG.normal(size=(3, 1)), 100, axis=0)):
        points, ids = np.concatenate([rows[:40], RNG.normal(size=(20, rows.shape[1]))]), RNG.permutation(300) // 2
        i, j, d = boxes.nearest(points, ids[:60], np.full(60, np.inf), rows, ids, k, skip)
        assert list(zip(i.tolist(), ids[j].tolist(), d.tolist())) == brute(points, ids[:60], rows, ids, k, skip)
        radii, weights = RNG.random(300) * RNG.integers(0, 2, 300), RNG.integers(1, 4, 300)
        want = [int(weights[np.sqrt(((rows - p) ** 2).sum(axis=1)) <= radii].sum()) for p in points]
        assert boxes.inside_balls(points, rows, radii, weights).tolist() == want


def test_a_query_meets_few_rows(monkeypatch):
    met, distances = [0], boxes.distances

    def noted(a, b):
        d = distances(a, b)
        met[0] += d.size
        return d

    monkeypatch.setattr(boxes, "distances", noted)
    for n in (2_000, 40_000):
        met[0] = 0
        boxes.nearest(lines(n), np.arange(n), np.full(n, np.inf), lines(n), np.arange(n), 5, False)
        assert met[0] < 250 * n


def test_narrow_tables_are_cut_into_boxes(spark, monkeypatch):
    """Hot points that no cut can part, repeated ids and blocks of few rows."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "_Grid", None)
    spark.conf.set(BROADCAST_BYTES_CONF, "0")
    try:
        points = np.concatenate([lines(250), np.full((150, 2), 0.5)])
        ids = np.r_[np.arange(390), np.arange(10)]
        table = spark.createDataFrame([(int(i), [float(x) for x in p], 0.03) for i, p in zip(ids, points)], "id long, vector array<double>, r double")
        once = table.where("id >= 10")
        found = sorted((r["query_id"], r["rank"], r["base_id"], r["distance"]) for r in neighbours.knn(once, table, 3, skip_same_id=True).collect())
        own = ids >= 10
        want = brute(points[own], ids[own], points, ids, 3, True)
        assert [(int(ids[own][i]), b, pytest.approx(d)) for i, b, d in want] == [(a, b, d) for a, _, b, d in found]
        balls = {r["query_id"]: r["n"] for r in neighbours.ball_counts(once, table, "r").collect()}
        assert balls == {int(i): int((np.sqrt(((points - p) ** 2).sum(axis=1)) <= 0.03).sum()) for i, p in zip(ids[own], points[own])}
    finally:
        spark.conf.unset(BROADCAST_BYTES_CONF)


def test_features_are_summed_by_many_tasks(spark):
    """Rows that come from one file are dealt to all tasks."""
    real, syn = (spark.createDataFrame([(float(a), float(b)) for a, b in part], "a double, b double").coalesce(1) for part in (lines(200), lines(150) / 2))
    found = metrics.mean_discrepancy(real, syn, ["a", "b"])
    assert f"RoundRobinPartitioning({neighbours._parts(spark)})" in found._jdf.queryExecution().executedPlan().toString()
    again = metrics.mean_discrepancy(real.repartition(3), syn.repartition(5), ["a", "b"])
    assert found.first()[0] == pytest.approx(again.first()[0], rel=1e-9)
