"""The block-wise neighbour search against all distances."""

import numpy as np
import pytest

from plumbline.operators import neighbours
from plumbline.operators.neighbours import ball_counts, knn, knn_probed, locality_order, packed_blocks
from plumbline.session import BROADCAST_BYTES_CONF

RNG = np.random.default_rng(5)


def clusters(n, dim, centres=12, spread=0.08):
    middle = RNG.normal(size=(centres, dim))
    return middle[RNG.integers(centres, size=n)] + RNG.normal(scale=spread, size=(n, dim))


SETS = {
    "clusters": clusters(1500, 5),
    "noise": RNG.normal(size=(900, 8)),
    "hot point": np.concatenate([np.zeros((700, 3)), RNG.normal(size=(300, 3))]),
    "one value": np.ones((300, 2)),
    "line": np.arange(800, dtype="float64")[:, None] * 1e6,
    "grid of ties": np.stack(np.meshgrid(range(25), range(25)), -1).reshape(-1, 2).astype("float64"),
}


@pytest.fixture
def blocks(spark, monkeypatch):
    """No broadcast of the base, small blocks: many cells, many blocks, cut cells."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 90)
    monkeypatch.setattr(neighbours, "PIVOT_SLICE", 64)
    spark.conf.set(BROADCAST_BYTES_CONF, "0")
    yield
    spark.conf.unset(BROADCAST_BYTES_CONF)


def vectors(spark, points, start=0):
    return spark.createDataFrame([(i + start, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vector array<double>")


def all_distances(queries, base, k, same):
    out = []
    for i, p in enumerate(queries):
        d = np.sqrt(((base - p) ** 2).sum(axis=1))
        if same:
            d[i] = np.inf
        best = np.lexsort((np.arange(len(base)), d))[:k]
        out += [(i, int(b), r + 1) for r, b in enumerate(best) if np.isfinite(d[b])]
    return out


@pytest.mark.parametrize("name", SETS)
def test_exact_in_blocks(spark, blocks, name):
    points = SETS[name]
    found = knn(vectors(spark, points), vectors(spark, points), 4, skip_same_id=True).select("query_id", "base_id", "rank")
    assert sorted(tuple(r) for r in found.collect()) == sorted(all_distances(points, points, 4, True))


def test_exact_for_queries_from_elsewhere(spark, blocks):
    base, queries = SETS["clusters"], np.concatenate([RNG.normal(size=(60, 5)) * 4, np.full((3, 5), 1e5), SETS["clusters"][:40]])
    found = knn(vectors(spark, queries), vectors(spark, base), 7).select("query_id", "base_id", "rank")
    assert sorted(tuple(r) for r in found.collect()) == sorted(all_distances(queries, base, 7, False))


def test_fewer_rows_than_neighbours(spark, blocks):
    base = SETS["noise"][:3]
    found = knn(vectors(spark, base), vectors(spark, base), 10, skip_same_id=True).select("query_id", "base_id", "rank")
    assert sorted(tuple(r) for r in found.collect()) == sorted(all_distances(base, base, 10, True))


def test_copies_are_bounded_and_blocks_left_out(spark, blocks):
    points = SETS["clusters"]
    frame = vectors(spark, points)
    grid = neighbours._Grid(frame, "id", "vector", None)
    assert len(grid.cells.pivots) <= round(len(points) ** 0.5) and grid.blocks <= 2 * len(points) // 90 + 2
    assert max(r["count"] for r in grid.rows.groupBy("block").count().collect()) <= 2 * 90
    home = grid.home(frame)
    assert home.count() == len(points)
    limits = knn(frame, frame, 4, skip_same_id=True).where("rank = 4").selectExpr("query_id as id", "distance as limit")
    more = grid.beyond_home(frame, limits)
    assert more.groupBy("id", "block").count().where("count > 1").count() == 0
    assert more.count() < 0.4 * len(points) * (grid.blocks - 1)  # clusters: most blocks need no visit


def test_probed_search_says_where_it_is_exact(spark, blocks):
    points = clusters(3000, 6, centres=30, spread=0.3)
    frame = vectors(spark, points)
    want = {}
    for i, b, _ in all_distances(points, points, 5, True):
        want.setdefault(i, set()).add(b)
    found = knn_probed(frame, frame, 5, probes=6, skip_same_id=True).collect()
    hits = sum(r["base_id"] in want[r["query_id"]] for r in found)
    assert hits / (5 * len(points)) >= 0.9
    certain = [r for r in found if r["certain"]]
    assert len(certain) > len(found) // 4 and all(r["base_id"] in want[r["query_id"]] for r in certain)
    assert len(found) == 5 * len(points)
    all_cells = knn_probed(frame, frame, 5, probes=10_000, skip_same_id=True).collect()
    assert all(r["certain"] and r["base_id"] in want[r["query_id"]] for r in all_cells)


def test_ball_counts_in_blocks(spark, blocks):
    base, queries = SETS["clusters"], SETS["clusters"][:200] + 0.05
    radii = RNG.uniform(0.01, 0.3, len(base))
    frame = spark.createDataFrame([(i, [float(x) for x in p], float(r)) for i, (p, r) in enumerate(zip(base, radii))], "id long, vector array<double>, r double")
    inside = (np.sqrt(((queries[:, None] - base[None]) ** 2).sum(-1)) <= radii[None]).sum(axis=1)
    assert {r["query_id"]: r["n"] for r in ball_counts(vectors(spark, queries), frame, "r").collect()} == {i: int(n) for i, n in enumerate(inside) if n}


def test_block_packing():
    first, pieces, blocks = packed_blocks(np.array([3, 4, 25, 1, 1, 10, 2]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5, 6] and pieces.tolist() == [1, 1, 3, 1, 1, 1, 1] and blocks == 7
    order = locality_order(RNG.normal(size=(37, 3)))
    assert sorted(order.tolist()) == list(range(37))
