import numpy as np
import pytest

from plumbline.llm import tiles
from plumbline.llm.tiles import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, component string, dim int, block int"


def brute(rows, threshold=0.95):
    def unit(x):
        if x is None or not len(x) or any(v is None or not np.isfinite(v) for v in x) or not any(x):
            return None
        x = np.asarray(x, dtype=np.float64)
        x = x / np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    units = [unit(e) if i is not None else None for i, e in rows]
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            x, y = units[a], units[b]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
                links[a].add(b), links[b].add(a)
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b), todo.append(b)
        least = None if i is None else min(rows[b][0] for b in seen)
        out.append((i, len(links[a]), least, i is not None and i == least))
    return sorted(out, key=repr)


def run(spark, rows, schema=SCHEMA, **options):
    clash = [(i, e, 1, 2, "x", 3, 4) for i, e in rows]
    return sorted((tuple(r) for r in near_vectors(spark.createDataFrame(clash, schema), **options).collect()), key=repr)


def vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    out = [base[rng.integers(len(base))] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.3, 0.33]) for _ in range(n)]
    return [(int(7 * k + 1), [float(np.float32(v)) for v in x * rng.choice([1e-3, 1.0, 50.0])]) for k, x in enumerate(out)]


@pytest.mark.parametrize("block", [1024, 40])
def test_agrees_with_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "LEAST_BLOCK", block)
    monkeypatch.setattr(tiles, "STEP", 33)
    rows = vectors(300, 24)
    assert run(spark, rows) == brute(rows)


def test_doubles_and_other_threshold(spark):
    rows = vectors(120, 8, seed=3)
    assert run(spark, rows, SCHEMA.replace("float", "double"), threshold=0.8) == brute(rows, 0.8)


def test_edges_of_the_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0]), (10, [5.0]), (11, [-1.0, 0.0]), (None, [1.0, 0.0]), (12, [1e-38, 1e-38]), (13, [1e37, 1e37])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = tiles.unit(rng.normal(size=(400, 64)) * rng.choice([1, 30], size=(400, 64)))
    q, s, e = tiles.quantise(x)
    approx = (q.astype(float) @ q.astype(float).T) * s[:, None] * s
    assert (np.abs(approx - x @ x.T) <= e[:, None] + e + e[:, None] * e).all()


def test_long_vectors_are_multiplied_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tiles, "EXACT_DIMS", 16)
    rows = vectors(60, 50, seed=8)
    assert run(spark, rows) == brute(rows)
