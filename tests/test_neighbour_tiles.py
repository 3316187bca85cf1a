"""Distances are held by the tile, and a base table of many rows is cut into blocks even where its bytes would fit a broadcast."""

import numpy as np
import pytest

from plumbline.operators import neighbours

RNG = np.random.default_rng(17)
POINTS = {
    "noise": RNG.normal(size=(900, 3)),
    "copies": np.concatenate([np.zeros((500, 2)), RNG.normal(size=(200, 2))]),
    "ties": RNG.integers(0, 7, size=(700, 2)).astype("float64"),
}


@pytest.fixture
def largest(monkeypatch):
    """The largest matrix of distances that a search has held."""
    seen, squared = [0], neighbours._squared

    def noted(a, b):
        seen[0] = max(seen[0], len(a) * len(b))
        return squared(a, b)

    monkeypatch.setattr(neighbours, "_squared", noted)
    monkeypatch.setattr(neighbours, "QUERY_SLICE", 16)
    monkeypatch.setattr(neighbours, "BASE_SLICE", 64, raising=False)
    return seen


@pytest.mark.parametrize("name", POINTS)
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_nearest_by_the_tile(largest, name, k):
    points = POINTS[name]
    ids = RNG.permutation(len(points))
    found = neighbours._top_k(k, True)(ids[:100], points[:100], ids, points, None)
    assert largest[0] <= 16 * 64
    want = []
    for i in range(100):
        d = neighbours._distance(points[i], points)
        best = np.lexsort((ids, d))
        want += [(ids[i], ids[j]) for j in best[best != i][:k]]
    assert list(zip(found["query_id"], found["base_id"])) == want


def test_balls_by_the_tile(largest):
    points = POINTS["copies"]
    ids, radii = np.arange(len(points)), RNG.random(len(points))
    found = neighbours._ball_count()(ids, points, ids, points, radii)
    assert largest[0] <= 16 * 64
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert found["n"].tolist() == (d <= radii[None]).sum(axis=1).tolist()


def test_many_narrow_rows_are_not_shipped(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHIPPED_ROWS", 100, raising=False)
    table = spark.createDataFrame([(i, [float(i)]) for i in range(101)], "id long, vector array<double>")
    assert not neighbours.fits_broadcast(table, "vector")
    assert neighbours.fits_broadcast(table.where("id < 100"), "vector")
    found = {(r["query_id"], r["base_id"]) for r in neighbours.knn(table.where("id < 3"), table, 1, skip_same_id=True).collect()}
    assert found == {(0, 1), (1, 0), (2, 1)}
