"""Hard negatives against all scores, and the early end of a search."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.negatives import hard_negatives, threshold_search

SCHEMA = "vec_id long, label int, embedding array<float>, rank int, row long, score string, dim int"


def lists_of(parts):
    return np.argsort(parts, axis=0, kind="stable").T


def plain(rows, positives=5, negatives=5, low=80, high=100):
    """All scores of every anchor; ids divisible by 10 are anchors."""
    fine = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in e]) for i, lab, e in rows if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for k, (i, lab, e) in enumerate(fine):
        if i is None or i % 10:
            continue
        scored = [(j, sum(x * y for x, y in zip(e, f)), lab2) for m, (j, lab2, f) in enumerate(fine) if m != k and len(f) == len(e)]
        for p in sorted((s for s in scored if s[2] == lab), key=key)[:positives]:
            inside = sorted((s for s in scored if s[2] != lab and low * p[1] <= 100 * s[1] <= high * p[1]), key=key)[:negatives]
            out.extend((i, p[0], r + 1, s[0], p[1], s[1]) for r, s in enumerate(inside))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 7, 8, "x", 9) for r in rows], SCHEMA)
    found = hard_negatives(frame, "vec_id % 10 = 0", **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    out = [(k, rng.randrange(3), [round(c + rng.gauss(0, 0.6), 1) for c in centres[rng.randrange(3)]]) for k in range(160)]
    out += out[:25]  # repeated rows, anchors among them
    out += [(300 + k, k % 3, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]) for k in range(21)]  # ties
    out += [(400, 1, None), (410, None, [1.0] * 6), (420, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (430, 1, [float("nan")] * 6), (440, 2, [float("inf")] * 6)]
    out += [(None, 1, [0.9] * 6), (None, 0, [0.9] * 6), (450, 1, [0.0] * 6), (460, 1, []), (461, 1, []), (462, 2, []), (470, 1, [2.0]), (471, 1, [1.0]), (472, 0, [1.9])]
    rng.shuffle(out)
    return out


def test_against_all_scores(spark, rows):
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, positives=2, negatives=30, low=10, high=95) == plain(rows, 2, 30, 10, 95)


def test_many_blocks_and_chunks_of_anchors(spark, rows, monkeypatch):
    monkeypatch.setattr("plumbline.llm.negatives.LEAST_BLOCK", 16)
    monkeypatch.setattr("plumbline.llm.negatives.ANCHORS", 5)
    assert run(spark, rows) == plain(rows)


def test_empty_table_and_no_anchor(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, 1, [1e30]), (1, 1, [1e30]), (2, 2, [1e30])])


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 9), st.integers(1, 6))
def test_search_equals_all_scores(seed, n, dim, best):
    rng = np.random.default_rng(seed)
    parts = rng.integers(-4, 5, (n, dim))
    anchor = rng.integers(-3, 4, dim)
    fits = rng.random(n) < 0.6
    windows = [(None, None), (1, 6), (-9, 0), (5, None)]
    for (low, high), (where, got) in zip(windows, threshold_search(parts, lists_of(parts), anchor, fits, windows, best)):
        scores = parts @ anchor
        inside = [(-s, k) for k, s in enumerate(scores.tolist()) if fits[k] and (low is None or s >= low) and (high is None or s <= high)]
        assert [(-s, k) for k, s in zip(where.tolist(), got.tolist())] == sorted(inside)[:best]


def test_search_ends_early_where_components_decide():
    """A few rows stand out, so the sum of the values last met soon falls below them: most rows are never scored."""
    rng = np.random.default_rng(0)
    parts = rng.integers(0, 50, (20000, 4))
    parts[:6] = 500

    class Counted(np.ndarray):
        met = 0

        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                Counted.met += len(key)
            return np.asarray(self)[key]

    found = threshold_search(parts.view(Counted), lists_of(parts), np.array([3, 1, 2, 1]), np.ones(len(parts), bool), [(None, None)], 5)
    assert found[0][0].tolist() == [0, 1, 2, 3, 4]
    assert Counted.met < 500
