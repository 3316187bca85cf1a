"""Exact neighbour search among rows of few columns: rows are halved into cells with tight boxes, and pairs of a query and a cell are
dropped by the distance of the query to the box. Differences, squares, sums and roots round monotonically and a box is measured by the
same steps as a row, so no row can be nearer than its box, not even by rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CELL_ROWS = 32
PAIRS = 400_000  # pairs of rows, or of groups and cells, that are held at a time


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to those of ``b``, column by column."""
    total = 0.0
    for c in range(a.shape[-1]):
        diff = a[..., c] - b[..., c]
        total = total + diff * diff
    return np.sqrt(total)


def gaps(low: np.ndarray, high: np.ndarray, box_low: np.ndarray, box_high: np.ndarray) -> np.ndarray:
    """Least distances between the boxes ``low`` to ``high`` and other boxes; a point is a box without extent."""
    total = 0.0
    for c in range(low.shape[-1]):
        away = np.maximum(np.maximum(box_low[..., c] - high[..., c], low[..., c] - box_high[..., c]), 0.0)
        total = total + away * away
    return np.sqrt(total)


class Halves:
    """Rows halved along the widest axis, again and again, until at most ``most`` are left; ``order`` lists them cell by cell.

    A cut lies between two values of the axis where one is near the middle; otherwise equal values are told apart by the other columns.
    """

    def __init__(self, rows: np.ndarray, most: int):
        n, width = rows.shape
        self.order, ends, place = np.arange(n), np.array([0, n]), np.zeros(1, np.int64)
        rank = np.empty(n, np.int64)
        rank[np.lexsort(rows.T[::-1])] = np.arange(n)
        # per node of the tree: axis (-1 in a cell), the least row of its right side, children
        axes, cuts, children = [np.full(1, -1)], [np.zeros((1, width + 1))], [np.zeros((1, 2), np.int64)]
        self.depth, nodes = 0, 1
        while (wide := np.diff(ends) > most).any():
            sizes = np.diff(ends)[wide]
            first = np.cumsum(sizes) - sizes
            at = np.repeat(ends[:-1][wide] - first, sizes) + np.arange(sizes.sum())
            own = self.order[at]
            part, node = rows[own], np.repeat(np.arange(len(sizes)), sizes)
            axis = np.argmax(np.maximum.reduceat(part, first) - np.minimum.reduceat(part, first), axis=1)
            value = part[np.arange(len(own)), axis[node]]
            again = np.lexsort((rank[own], value, node))
            value, own = value[again], own[again]
            self.order[at] = own
            middle = first + sizes // 2
            off = np.abs(np.arange(len(own)) - middle[node])
            off[np.r_[True, (value[1:] == value[:-1]) | (node[1:] != node[:-1])]] = len(own)
            least = np.minimum.reduceat(off, first)
            clean = least <= sizes // 4
            cut = np.where(clean, np.minimum.reduceat(np.where(off == least[node], np.arange(len(own)), len(own)), first), middle)
            least_row = np.c_[value[cut], np.where(clean[:, None], -np.inf, rows[own[cut]])]
            # children are numbered after all nodes so far
            inner, new = place[wide], nodes + np.arange(2 * len(sizes)).reshape(-1, 2)
            nodes, self.depth = nodes + 2 * len(sizes), self.depth + 1
            tree = np.concatenate(axes), np.concatenate(cuts), np.concatenate(children)
            tree[0][inner], tree[1][inner], tree[2][inner] = axis, least_row, new
            axes, cuts, children = [tree[0], np.full(new.size, -1)], [tree[1], np.zeros((new.size, width + 1))], [tree[2], np.zeros((new.size, 2), np.int64)]
            starts = np.r_[ends[:-1], ends[:-1][wide] + cut - first]
            kept = place.copy()
            kept[wide] = new[:, 0]
            by_start = np.argsort(starts)
            ends, place = np.r_[starts[by_start], n], np.r_[kept, new[:, 1]][by_start]
        self.axis, self.cut, self.child = np.concatenate(axes), np.concatenate(cuts), np.concatenate(children)
        self.cell = np.full(nodes, -1)
        self.cell[place] = np.arange(len(place))
        self.first, self.stop = ends[:-1], ends[1:]
        part = rows[self.order]
        self.low, self.high = np.minimum.reduceat(part, self.first), np.maximum.reduceat(part, self.first)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The cell on whose side of all cuts each point lies."""
        node, every = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            axis, cut = self.axis[node], self.cut[node]
            value = points[every, axis]
            beyond, same = value > cut[:, 0], value == cut[:, 0]
            for c in range(points.shape[1]):
                beyond |= same & (points[:, c] > cut[:, c + 1])
                same &= points[:, c] == cut[:, c + 1]
            node = np.where(axis < 0, node, self.child[node, (beyond | same).astype(np.int64)])
        return self.cell[node]


def _expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(item, place)``: every item as often as its count says, and the copies numbered from 0."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of items whose counts add up to about ``most``."""
    total = np.cumsum(counts)
    start = 0
    while start < len(counts):
        stop = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")), start + 1)
        yield slice(start, stop)
        start = stop


def others_in_reach(points: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray, own: int) -> np.ndarray:
    """Which points have a box other than ``own`` within their reach."""
    if not len(points):
        return np.zeros(0, np.int64)
    close = gaps(points.min(axis=0)[None], points.max(axis=0)[None], low, high) <= reach.max()
    close[own] = False
    low, high = low[close], high[close]
    out, step = [np.zeros(0, np.int64)], max(PAIRS // max(len(low), 1), 1)
    for at in range(0, len(points) if len(low) else 0, step):
        some = points[at : at + step, None]
        out.append(at + np.flatnonzero((gaps(some, some, low[None], high[None]) <= reach[at : at + step, None]).any(axis=1)))
    return np.concatenate(out)


def pairs_in_balls(points: np.ndarray, home: np.ndarray, low: np.ndarray, high: np.ndarray, balls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(points, boxes)`` of the pairs where the point lies within the box or within its largest ball around it."""
    return _cell_pairs(low, high, points, home, None, balls) if len(points) and len(low) else iter(())


def _cell_pairs(cell_low: np.ndarray, cell_high: np.ndarray, points: np.ndarray, home: np.ndarray, reach: np.ndarray | None, balls: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(points, cells)`` of pairs that may hold a hit: the box lies within the reach of the point, or the point within the cell's largest ball."""
    order = np.argsort(home, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(home[order]) > 0])
    size = np.diff(np.r_[first, len(order)])
    low, high = np.minimum.reduceat(points[order], first), np.maximum.reduceat(points[order], first)
    far = None if reach is None else np.maximum.reduceat(reach[order], first)
    step = max(PAIRS // len(cell_low), 1)
    for at in range(0, len(first), step):
        part = slice(at, at + step)
        away = gaps(low[part, None], high[part, None], cell_low[None], cell_high[None])
        group, cell = np.nonzero(away <= (balls[None] if far is None else far[part, None]))
        group = group + at
        for some in _slices(size[group], PAIRS):
            item, place = _expanded(size[group[some]])
            point, other = order[first[group[some]][item] + place], cell[some][item]
            away = gaps(points[point], points[point], cell_low[other], cell_high[other])
            near = away <= (balls[other] if reach is None else reach[point])
            yield point[near], other[near]


def _row_pairs(cells: Halves, point: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(points, places in the order of the cells)`` of all rows of the pairs' cells."""
    size = cells.stop - cells.first
    for some in _slices(size[cell], PAIRS):
        item, place = _expanded(size[cell[some]])
        yield point[some][item], cells.first[cell[some]][item] + place


def _first_copies(rows: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among ``k`` nearest: of equal rows those of the ``k + 1`` smallest codes, each at most ``k`` times."""
    order = np.lexsort((codes, *rows.T))
    new = np.r_[True, (rows[order[1:]] != rows[order[:-1]]).any(axis=1)]
    if new.all():
        return np.arange(len(rows))
    other = new | np.r_[True, codes[order[1:]] != codes[order[:-1]]]
    code, every = np.cumsum(other), np.arange(len(order))
    rank = code - np.maximum.accumulate(np.where(new, code, 0))
    copy = every - np.maximum.accumulate(np.where(other, every, 0))
    return np.sort(order[(rank <= k) & (copy < k)])


def nearest(points: np.ndarray, codes: np.ndarray, limit: np.ndarray, rows: np.ndarray, row_codes: np.ndarray, k: int, skip_same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(point, row, distance)`` of the ``k`` nearest rows of each point, ties by code, none beyond the point's limit.

    ``skip_same`` leaves out rows with the code of the point.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(points) or not len(rows):
        return nothing
    kept = _first_copies(rows, row_codes, k)
    cells = Halves(rows[kept], max(CELL_ROWS, 2 * (k + 1)))
    kept = kept[cells.order]
    held, held_codes = rows[kept], row_codes[kept]
    home, reach = cells.home(points), limit.copy()
    width = int((cells.stop - cells.first).max())
    for at in range(0, len(points), max(PAIRS // width, 1)):
        some = slice(at, at + max(PAIRS // width, 1))
        place = cells.first[home[some], None] + np.arange(width)
        inside = place < cells.stop[home[some], None]
        place = np.minimum(place, len(held) - 1)
        d = distances(points[some, None], held[place])
        d[~inside | (skip_same & (held_codes[place] == codes[some, None]))] = np.inf
        if width >= k:
            reach[some] = np.minimum(reach[some], np.partition(d, k - 1, axis=1)[:, k - 1])
    found = [nothing]
    for point, cell in _cell_pairs(cells.low, cells.high, points, home, reach, None):
        for i, j in _row_pairs(cells, point, cell):
            d = distances(points[i], held[j])
            hit = (d <= reach[i]) & (d < np.inf)
            if skip_same:
                hit &= held_codes[j] != codes[i]
            found.append((i[hit], j[hit], d[hit]))
            if sum(len(f[0]) for f in found[1:]) > max(8 * PAIRS, 4 * k * len(points)):
                found = [_best(*(np.concatenate(x) for x in zip(*found)), held_codes, k)]
    i, j, d = _best(*(np.concatenate(x) for x in zip(*found)), held_codes, k)
    return i, kept[j], d


def _best(i: np.ndarray, j: np.ndarray, d: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((codes[j], d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], d[first]


def inside_balls(points: np.ndarray, rows: np.ndarray, radii: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each point the weights of the rows that have it inside their own ball."""
    counts = np.zeros(len(points), np.int64)
    if not len(points) or not len(rows):
        return counts
    order = np.lexsort((radii, *rows.T))
    new = np.flatnonzero(np.r_[True, (rows[order[1:]] != rows[order[:-1]]).any(axis=1) | (radii[order[1:]] != radii[order[:-1]])])
    rows, radii, weights = rows[order[new]], radii[order[new]], np.add.reduceat(weights[order], new)
    cells = Halves(rows, CELL_ROWS)
    rows, radii, weights = rows[cells.order], radii[cells.order], weights[cells.order]
    for point, cell in _cell_pairs(cells.low, cells.high, points, cells.home(points), None, np.maximum.reduceat(radii, cells.first)):
        for i, j in _row_pairs(cells, point, cell):
            hit = distances(points[i], rows[j]) <= radii[j]
            np.add.at(counts, i[hit], weights[j[hit]])
    return counts
