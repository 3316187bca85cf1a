"""Exact nearest neighbours and ball counts between two tables of vectors.

A base table whose size and rows are checked to be few is shipped to the tasks of the query table. Otherwise the base
table is cut into cells around pivots, whose number grows with the square root of the rows, and cells are
gathered or cut into blocks of bounded size. Bounds on the distance of a cell decide which blocks a query must
visit and, inside a block, which cells it may leave out. Tasks emit at most ``k`` rows per query and block,
never all pairs. A query is copied at most once per block, a block once per ``BLOCK_ROWS`` of its visitors.
Distances are held for one tile of ``QUERY_SLICE`` by ``BASE_SLICE`` rows at a time, whatever the size of the tables.

Rows of at most ``NARROW`` columns are cut into boxes by halving instead, among the blocks and once more inside a block
(``functions/boxes.py``): the work per query then grows with the logarithm of the rows, not with their square root.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions import boxes
from plumbline.operators.common import q
from plumbline.operators.ranks import bounded_sample
from plumbline.session import broadcast_bytes, materialize

LEAST_PIVOTS, MOST_PIVOTS = 16, 8192
BLOCK_ROWS = 50_000
SHIPPED_ROWS = 200_000  # more base rows are cut into blocks, as every query meets every shipped row
QUERY_SLICE, BASE_SLICE = 128, 4096
ASKED_SLICE = 4096  # queries of a block whose bounds to its cells are held at a time
PAIR_SLICE = 16_384  # pairs whose differences are held at a time
PIVOT_SLICE = 256  # rows whose distances to all pivots are held at a time
NARROW = 4  # columns up to which rows are cut into boxes
BOX_SAMPLE = 64  # rows of the sample per block that the boxes are cut from

# (query ids, query matrix, base ids, base matrix, base radii) -> frame of results
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


def as_vector(columns: Sequence[str], scale: dict[str, tuple[float, float]] | None = None) -> Column:
    """Array of doubles from numeric columns, each mapped by ``(low, span)`` to ``(x - low) / span``."""
    cells = []
    for c in columns:
        value = q(c).cast("double")
        if scale is not None:
            low, span = scale[c]
            value = (value - F.lit(low)) / F.lit(span if span > 0 else 1.0)
        cells.append(F.coalesce(value, F.lit(0.0)))
    return F.array(*cells)


def min_max(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """``column -> (min, max - min)`` in one scan."""
    row = df.agg(
        *[F.min(q(c)).cast("double").alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(q(c)).cast("double").alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    out = {}
    for i, c in enumerate(columns):
        low, high = row[f"a{i}"], row[f"b{i}"]
        out[c] = (0.0, 1.0) if low is None else (low, high - low)
    return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64") if len(vectors) else np.zeros((0, 1))


def _squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Fast squared distances and a bound on their rounding error."""
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d = na[:, None] + nb[None, :] - 2.0 * (a @ b.T)
    slack = 1e-10 * (float(na.max(initial=0.0)) + float(nb.max(initial=0.0)) + 1e-300)
    return d, slack


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = a - b
    return np.sqrt((diff * diff).sum(axis=-1))


def _pair_distances(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact distances of the pairs ``a[i], b[j]``, a slice of pairs at a time."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIR_SLICE):
        part = slice(at, at + PAIR_SLICE)
        out[part] = _distance(a[i[part]], b[j[part]])
    return out


class _Best:
    """The ``k`` nearest base rows of each query so far, by exact distance and then by id."""

    def __init__(self, q_ids: np.ndarray, qm: np.ndarray, b_ids: np.ndarray, bm: np.ndarray, k: int, skip_same_id: bool, limit: np.ndarray):
        self.q_ids, self.qm, self.b_ids, self.bm, self.k, self.skip_same_id = q_ids, qm, b_ids, bm, k, skip_same_id
        self.limit = limit.copy()  # no row farther than this is among the nearest
        self.distance, self.place = np.full((len(q_ids), k), np.inf), np.full((len(q_ids), k), -1, np.int64)

    def look(self, some: np.ndarray, start: int, stop: int) -> None:
        """Queries ``some`` against base rows ``start`` to ``stop``, tile by tile."""
        for at in range(start, stop, BASE_SLICE):
            end = min(at + BASE_SLICE, stop)
            near, slack = _squared(self.qm[some], self.bm[at:end])
            if self.skip_same_id:
                near[self.q_ids[some][:, None] == self.b_ids[None, at:end]] = np.inf
            with np.errstate(over="ignore"):
                most = np.minimum(self.limit[some] ** 2 * (1 + 1e-12) + 2 * slack, np.finfo("float64").max)
            hit = near <= most[:, None]
            if end - at > self.k and np.count_nonzero(hit) > 4 * self.k * len(some):
                most = np.minimum(most, np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
                hit = near <= most[:, None]
            i, j = np.nonzero(hit)
            if len(i):
                self._merge(some[i], at + j)

    def _merge(self, rows: np.ndarray, places: np.ndarray) -> None:
        touched = np.unique(rows)
        kept = self.place[touched].ravel()
        r = np.r_[np.repeat(touched, self.k)[kept >= 0], rows]
        p = np.r_[kept[kept >= 0], places]
        d = np.r_[self.distance[touched].ravel()[kept >= 0], _pair_distances(self.qm, rows, self.bm, places)]
        order = np.lexsort((self.b_ids[p], d, r))
        r, p, d = r[order], p[order], d[order]
        at = np.arange(len(r)) - np.searchsorted(r, r)
        first = at < self.k
        self.distance[r[first], at[first]], self.place[r[first], at[first]] = d[first], p[first]
        self.limit[touched] = np.minimum(self.limit[touched], self.distance[touched, self.k - 1])

    def frame(self) -> pd.DataFrame:
        row, at = np.nonzero(self.place >= 0)
        return pd.DataFrame({"query_id": self.q_ids[row], "base_id": self.b_ids[self.place[row, at]], "distance": self.distance[row, at]})


def _top_k(k: int, skip_same_id: bool) -> Kernel:
    def kernel(q_ids, qm, b_ids, bm, _radii) -> pd.DataFrame:
        best = _Best(q_ids, qm, b_ids, bm, k, skip_same_id, np.full(len(q_ids), np.inf))
        for start in range(0, len(q_ids), QUERY_SLICE):
            best.look(np.arange(start, min(start + QUERY_SLICE, len(q_ids))), 0, len(b_ids))
        return best.frame()

    return kernel


def _count_inside(counts: np.ndarray, qm: np.ndarray, some: np.ndarray, bm: np.ndarray, radii: np.ndarray, start: int, stop: int) -> None:
    """Adds to ``counts`` how many balls of base rows ``start`` to ``stop`` hold the queries ``some``."""
    for at in range(start, stop, BASE_SLICE):
        end = min(at + BASE_SLICE, stop)
        d, slack = _squared(qm[some], bm[at:end])
        i, j = np.nonzero(d <= (radii[at:end] * radii[at:end])[None, :] + 2 * slack)
        inside = _pair_distances(qm, some[i], bm, at + j) <= radii[at + j]
        np.add.at(counts, some[i[inside]], 1)


def _ball_count() -> Kernel:
    def kernel(q_ids, qm, b_ids, bm, radii) -> pd.DataFrame:
        counts = np.zeros(len(q_ids), dtype="int64")
        for start in range(0, len(q_ids), QUERY_SLICE):
            _count_inside(counts, qm, np.arange(start, min(start + QUERY_SLICE, len(q_ids))), bm, radii, 0, len(b_ids))
        hit = counts > 0
        return pd.DataFrame({"query_id": q_ids[hit], "n": counts[hit]})

    return kernel


def knn(
    queries: DataFrame, base: DataFrame, k: int, id_col: str = "id", vector: str = "vector", skip_same_id: bool = False
) -> DataFrame:
    """``(query_id, base_id, distance, rank)``: the exact ``k`` nearest base rows, ties by base id.

    Large base tables take two rounds. The first searches the block around each query, which gives a distance that the k-th
    neighbour cannot exceed; the second sends the query only to blocks that may hold something nearer.
    """
    kernel = _top_k(k, skip_same_id)
    schema = f"query_id {_id_type(queries, id_col)}, base_id {_id_type(base, id_col)}, distance double"
    if fits_broadcast(base.select(q(vector)), vector):
        found = _against_all(queries, base, id_col, vector, None, kernel, schema)
    elif width := _narrow(base, vector):
        found = _Boxes(base, id_col, vector, None, width).nearest(queries, k, skip_same_id, schema)
    else:
        grid = _Grid(base, id_col, vector, None)
        at_home = materialize(grid.search(grid.home(queries), _nearest(k, skip_same_id), schema))
        limits = _ranked(at_home, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("limit"))
        found = at_home.unionByName(grid.search(grid.beyond_home(queries, limits), _nearest(k, skip_same_id), schema))
    return _ranked(found, k)


def knn_probed(
    queries: DataFrame, base: DataFrame, k: int, probes: int, id_col: str = "id", vector: str = "vector", skip_same_id: bool = False
) -> DataFrame:
    """``(query_id, base_id, distance, rank, certain)``: an approximate search that says where it is exact.

    A query is sent only to the blocks that hold the ``probes`` cells nearest to it, so it is copied at most ``probes`` times.
    ``certain`` holds where every block left out is provably farther than the row: these rows are those of :func:`knn`.
    Measure the recall of a choice of ``probes`` on a few queries against :func:`knn`. A base table small enough to be shipped is searched in full.
    """
    if probes < 1:
        raise ValueError("at least one cell must be searched")
    schema = f"query_id {_id_type(queries, id_col)}, base_id {_id_type(base, id_col)}, distance double"
    if fits_broadcast(base.select(q(vector)), vector):
        return knn(queries, base, k, id_col, vector, skip_same_id).withColumn("certain", F.lit(True))
    grid = _Grid(base, id_col, vector, None)
    visits = grid.probed(queries, probes)
    found = _ranked(grid.search(visits, _nearest(k, skip_same_id), schema), k)
    outside = visits.select(F.col("id").alias("query_id"), "outside").distinct()
    return found.join(outside, "query_id").withColumn("certain", F.col("distance") < F.col("outside")).drop("outside")


def ball_counts(queries: DataFrame, base: DataFrame, radius: str, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """``(query_id, n)``: how many base rows have the query inside their own ball; queries in none are absent."""
    schema = f"query_id {_id_type(queries, id_col)}, n long"
    if fits_broadcast(base.select(q(vector)), vector):
        found = _against_all(queries, base, id_col, vector, radius, _ball_count(), schema)
    elif width := _narrow(base, vector):
        found = _Boxes(base, id_col, vector, radius, width).inside(queries, schema)
    else:
        grid = _Grid(base, id_col, vector, radius)
        found = grid.search(grid.in_reach(queries), _inside_balls, schema)
    return found.groupBy("query_id").agg(F.sum("n").alias("n"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ordered = W.partitionBy("query_id").orderBy("distance", "base_id")
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)


def _id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def fits_broadcast(df: DataFrame, vector: str) -> bool:
    """Checked size: rows times width of the vectors against the broadcast budget, and the rows against ``SHIPPED_ROWS``."""
    first = df.select(F.size(vector).alias("d")).first()
    rows = 0 if first is None else df.count()
    return rows == 0 or (rows <= SHIPPED_ROWS and rows * (first["d"] + 2) * 8 <= broadcast_bytes(df.sparkSession))


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _against_all(queries, base, id_col, vector, radius, kernel: Kernel, schema: str) -> DataFrame:
    """Every query against a base table that fits a broadcast."""
    spark = base.sparkSession
    ball = F.lit(0.0) if radius is None else q(radius).cast("double")
    local = base.select(q(id_col).alias("id"), q(vector).cast("array<double>").alias("v"), ball.alias("ball")).toPandas()
    if local.empty:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((local["id"].to_numpy(), _matrix(local["v"]), local["ball"].to_numpy(dtype="float64")))

    def against_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b_ids, bm, radii = shared.value
        for batch in batches:
            if len(batch):
                yield kernel(batch["id"].to_numpy(), _matrix(batch["v"]), b_ids, bm, radii)

    return queries.select(q(id_col).alias("id"), q(vector).cast("array<double>").alias("v")).repartition(_parts(spark), "id").mapInPandas(against_all, schema)


def _narrow(base: DataFrame, vector: str) -> int:
    """The length of all vectors where it is at most ``NARROW``, else 0."""
    least, most = base.agg(F.min(F.size(q(vector))), F.max(F.size(q(vector)))).first()
    return most if least == most and 0 < (most or 0) <= NARROW else 0


def _points(table: pa.Table | pa.RecordBatch, axes: Sequence[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in axes])


def _id_codes(asked: pa.ChunkedArray, held: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of the ids, nulls last; a null is not the same as any other."""
    both = pd.concat([ids.to_pandas(integer_object_nulls=True) for ids in (asked, held)], ignore_index=True)
    codes, known = pd.factorize(both, sort=True)
    a, b = codes[: len(asked)], codes[len(asked) :]
    return np.where(a < 0, -1, a), np.where(b < 0, len(known), b)


class _Boxes:
    """A base table of narrow vectors, cut into blocks of at most about ``BLOCK_ROWS`` rows by halving a sample of it.

    Every block has the tight box of its rows. Equal vectors share a block unless they are more than a block holds; then only those
    that can be among the nearest are kept, or equal balls are counted once with their number.
    """

    def __init__(self, base: DataFrame, id_col: str, vector: str, radius: str | None, width: int):
        self.spark = spark = base.sparkSession
        self.id_col, self.vector, self.radius, self.base = id_col, vector, radius, base
        self.axes = [f"x{i}" for i in range(width)]
        b = self._flat(base)
        if radius is not None:
            ball = q(radius).cast("double")
            b = self._flat(base, ball.alias("ball")).where((F.col("ball") >= 0) & ~F.isnan("ball"))
        rows = b.count()
        leaves = max(-(-2 * rows // BLOCK_ROWS), 1)
        wanted = min(BOX_SAMPLE * leaves, max(LEAST_PIVOTS, broadcast_bytes(spark) // (16 * width)))
        sample = np.array([r[:] for r in bounded_sample(b.where(self._finite()), "id", wanted).select(*self.axes).collect()], dtype="float64").reshape(-1, width)
        self.tree = boxes.Halves(sample, max(len(sample) // leaves, 1)) if len(sample) else boxes.Halves(np.zeros((1, width)), 1)
        self.placed = self._placed(b)
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in self.axes for f in (F.min, F.max)]
        own = self.placed.groupBy("leaf").agg(F.count("*").alias("n"), *ends, *([] if radius is None else [F.max("ball").alias("ball")])).orderBy("leaf").toPandas()
        self.stats = own
        leaf, sizes = own["leaf"].to_numpy(dtype="int64"), own["n"].to_numpy(dtype="int64")
        self.full = leaf[sizes > BLOCK_ROWS].tolist()

    def _flat(self, df: DataFrame, *more: Column) -> DataFrame:
        v = q(self.vector).cast("array<double>")
        return df.select(q(self.id_col).alias("id"), *[F.get(v, F.lit(i)).alias(c) for i, c in enumerate(self.axes)], *more)

    def _finite(self) -> Column:
        """Rows that have a distance to others."""
        found = F.lit(True)
        for c in self.axes:
            found &= F.abs(F.col(c)) < float("inf")
        return found

    def _placed(self, flat: DataFrame) -> DataFrame:
        """Rows with the leaf of the halving they lie in."""
        tree, axes = self.tree, self.axes

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column("leaf", pa.array(tree.home(_points(batch, axes)), pa.int32()))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)
        return materialize(flat.where(self._finite()).repartition(_parts(self.spark), "id").mapInArrow(assign, f"{kinds}, leaf int"))

    def _blocks(self, rows: DataFrame, key: Sequence[str]) -> DataFrame:
        """Settles the blocks of the leaves, with ``rows`` in the place of those of leaves that are too large, and gives all rows a block."""
        held = self.placed.where(~F.col("leaf").isin(self.full)).select(*rows.columns).unionByName(materialize(rows)) if self.full else rows
        sizes = dict(zip(self.stats["leaf"].tolist(), self.stats["n"].tolist()))
        if self.full:
            sizes |= {r["leaf"]: r["count"] for r in held.where(F.col("leaf").isin(self.full)).groupBy("leaf").count().collect()}
        pieces = np.array([-(-sizes[leaf] // BLOCK_ROWS) for leaf in self.stats["leaf"].tolist()], dtype="int64")
        first = np.cumsum(pieces) - pieces
        at = np.repeat(np.arange(len(pieces)), pieces)  # the leaf of each block
        ends = [self.stats[[f"{f}_{c}" for c in self.axes]].to_numpy(dtype="float64")[at] for f in ("min", "max")]
        self.low, self.high = ends
        self.balls = None if self.radius is None else self.stats["ball"].to_numpy(dtype="float64")[at]
        self.where = self.spark.createDataFrame(list(zip(self.stats["leaf"].tolist(), first.tolist(), pieces.tolist())), "leaf int, first int, pieces int")
        return self._in_block(held, key)

    def _in_block(self, rows: DataFrame, key: Sequence[str]) -> DataFrame:
        piece = F.pmod(F.xxhash64(*key), F.col("pieces"))
        return rows.join(F.broadcast(self.where), "leaf").withColumn("block", (F.col("first") + piece).cast("int")).drop("leaf", "first", "pieces")

    def nearest(self, queries: DataFrame, k: int, skip_same_id: bool, schema: str) -> DataFrame:
        """``(query_id, base_id, distance)`` with the ``k`` nearest rows of every query among others.

        The first round searches the block around each query and tells the queries that have another block within their k-th
        distance; the second sends these there.
        """
        same, axes = queries is self.base, self.axes
        full = self.placed.where(F.col("leaf").isin(self.full))
        by_id = W.partitionBy(*axes).orderBy(F.col("id").asc_nulls_last())
        few = full.withColumn("_rank", F.dense_rank().over(by_id)).where(F.col("_rank") <= k + 1).withColumn("_copy", F.row_number().over(W.partitionBy(*axes, "id").orderBy("id"))).where(F.col("_copy") <= k)
        rows = self._blocks(few.select(*self.placed.columns) if self.full else self.placed, ["id"])
        asked = self.placed.select(*[F.col(c).alias(c) for c in self.placed.columns]) if same else self._placed(self._flat(queries))
        asked = self._in_block(asked, ["id"])
        low, high = self.low, self.high

        def near(asked: pa.Table, held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            points, codes = _points(asked, axes), _id_codes(asked.column("id"), held.column("id"))
            limit = asked.column("limit").to_numpy() if "limit" in asked.column_names else np.full(len(points), np.inf)
            i, j, d = boxes.nearest(points, codes[0], limit, _points(held, axes), codes[1], k, skip_same_id)
            reach = limit.copy()
            last = np.flatnonzero(np.r_[i[1:] != i[:-1], True]) if len(i) else np.zeros(0, np.int64)
            whole = last[np.diff(np.r_[-1, last]) == k]
            reach[i[whole]] = np.minimum(reach[i[whole]], d[whole])
            return points, i, j, d, reach

        def at_home(asked: pa.Table, held: pa.Table) -> pa.Table:
            points, i, j, d, reach = near(asked, held)
            block = asked.column("block")[0].as_py() if len(points) else 0
            more = boxes.others_in_reach(points, reach, low, high, block)
            columns = {
                "query_id": pa.concat_arrays([asked.column("id").take(pa.array(x)).combine_chunks() for x in (i, more)]),
                "base_id": pa.concat_arrays([held.column("id").take(pa.array(j)).combine_chunks(), pa.nulls(len(more), held.schema.field("id").type)]),
                "distance": pa.array(np.r_[d, reach[more]]),
            }
            columns |= {c: pa.concat_arrays([pa.nulls(len(i), pa.float64()), pa.array(points[more, a])]) for a, c in enumerate(axes)}
            return pa.table({**columns, "home": pa.concat_arrays([pa.nulls(len(i), pa.int32()), pa.array(np.full(len(more), block), pa.int32())])})

        def beyond(asked: pa.Table, held: pa.Table) -> pa.Table:
            _, i, j, d, _ = near(asked, held)
            return pa.table({"query_id": asked.column("id").take(pa.array(i)), "base_id": held.column("id").take(pa.array(j)), "distance": pa.array(d)})

        cells = ", ".join(f"{c} double" for c in axes)
        first = materialize(self._met(asked, rows, at_home, f"{schema}, {cells}, home int"))
        found = first.where("home is null").select("query_id", "base_id", "distance")
        step = max(boxes.PAIRS // max(len(low), 1), 1)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    points = _points(part, axes)[:, None]
                    visit = boxes.gaps(points, points, low[None], high[None]) <= part.column("limit").to_numpy()[:, None]
                    visit[np.arange(len(visit)), part.column("home").to_numpy()] = False
                    row, block = np.nonzero(visit)
                    yield part.take(pa.array(row)).drop_columns(["home"]).append_column("block", pa.array(block, pa.int32()))

        open_ones = first.where("home is not null").select(F.col("query_id").alias("id"), *axes, F.col("distance").alias("limit"), "home")
        kind = schema.split(", ")[0].removeprefix("query_id ")
        visits = materialize(open_ones.repartition(_parts(self.spark), "id").mapInArrow(send, f"id {kind}, {cells}, limit double, block int"))
        return found.unionByName(self._met(visits, rows, beyond, schema))

    def inside(self, queries: DataFrame, schema: str) -> DataFrame:
        """``(query_id, n)`` for each block that has balls around the query."""
        axes, counted = self.axes, F.count("*").cast("long").alias("n")
        full = self.placed.where(F.col("leaf").isin(self.full)).groupBy(*self.axes, "ball", "leaf").agg(counted)
        self.placed = self.placed.withColumn("n", F.lit(1).cast("long")).drop("id")
        rows = self._blocks(full if self.full else self.placed, [*axes, "ball"])
        tree, low, high, balls = self.tree, self.low, self.high, self.balls

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = _points(batch, axes)
                for row, block in boxes.pairs_in_balls(points, tree.home(points), low, high, balls):
                    yield batch.take(pa.array(row)).append_column("block", pa.array(block, pa.int32()))

        def count(asked: pa.Table, held: pa.Table) -> pa.Table:
            n = boxes.inside_balls(_points(asked, axes), _points(held, axes), held.column("ball").to_numpy(), held.column("n").to_numpy())
            hit = np.flatnonzero(n)
            return pa.table({"query_id": asked.column("id").take(pa.array(hit)), "n": pa.array(n[hit])})

        flat = self._flat(queries).where(self._finite())
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)
        visits = materialize(flat.repartition(_parts(self.spark), "id").mapInArrow(send, f"{kinds}, block int"))
        return self._met(visits, rows, count, schema)

    def _met(self, visits: DataFrame, rows: DataFrame, kernel: Callable, schema: str) -> DataFrame:
        """Every visit against its block: both sides are cut so that no task holds more than about ``BLOCK_ROWS`` rows of either."""
        counts = {r["block"]: r["count"] for r in visits.groupBy("block").count().collect()}  # one row per block
        slices = self.spark.createDataFrame([(b, max(1, -(-n // BLOCK_ROWS))) for b, n in sorted(counts.items())], "block int, slices int")
        left = visits.join(F.broadcast(slices), "block").withColumn("slice", F.pmod(F.xxhash64("id", *self.axes), F.col("slices")).cast("int")).drop("slices")
        right = rows.join(F.broadcast(slices), "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

        parts = max(_parts(self.spark), 2 * sum(-(-n // BLOCK_ROWS) for n in counts.values()))  # few groups a task, as they are work, not bytes
        left, right = (side.repartition(parts, "block", "slice").groupBy("block", "slice") for side in (left, right))
        return left.cogroup(right).applyInArrow(kernel, schema)


@dataclass(frozen=True)
class Cells:
    """What tasks know of the base table: one row of numbers per cell."""

    pivots: np.ndarray
    inner: np.ndarray  # smallest and largest distance of a row to its pivot
    outer: np.ndarray
    ball: np.ndarray  # largest own radius of a row
    first: np.ndarray  # the cell's first block, and how many blocks it is cut into
    pieces: np.ndarray
    scale: float  # largest squared length of a row and a pivot, for the rounding of squared distances

    def distances(self, m: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(_squared(m, self.pivots)[0], 0.0))

    def lower_bounds(self, d: np.ndarray, cells: np.ndarray | None = None, home: np.ndarray | None = None, to_home: np.ndarray | None = None) -> np.ndarray:
        """Least distance a row of each cell can have to each query, from the distances ``d`` of queries to the pivots of ``cells``.

        Two bounds: the ring of a cell's rows around its pivot, and the plane halfway between its pivot and that of the query's own
        cell, beyond which all its rows lie.
        """
        cells = np.arange(len(self.pivots)) if cells is None else cells
        home = d.argmin(axis=1) if home is None else home
        to_home = d[np.arange(len(d)), home] if to_home is None else to_home
        ring = np.maximum(d - self.outer[cells], self.inner[cells] - d)
        apart = np.sqrt(np.maximum(_squared(self.pivots[home], self.pivots[cells])[0], 0.0))
        slack = 3e-12 * (self.scale + d * d)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d * d - (to_home * to_home)[:, None] - slack) / (2.0 * apart)
        plane[~(apart > self.scale**0.5 * 1e-6)] = 0.0
        return np.maximum(np.maximum(ring, plane) * (1 - 1e-9) - np.sqrt(slack), 0.0)

    def by_block(self, bounds: np.ndarray, blocks: int) -> np.ndarray:
        """Least bound over the cells of each block."""
        out = np.full((len(bounds), blocks), np.inf)
        order = np.argsort(self.first, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(self.first[order]) > 0])
        least = np.minimum.reduceat(bounds[:, order], starts, axis=1)
        for k, cell in enumerate(order[starts]):
            out[:, self.first[cell] : self.first[cell] + self.pieces[cell]] = least[:, k : k + 1]
        return out


def at_home(cells: Cells, home: np.ndarray, blocks: int) -> np.ndarray:
    """Which block a query visits first: that of the cell it lies in."""
    visit = np.zeros((len(home), blocks), dtype=bool)
    visit[np.arange(len(home)), cells.first[home]] = True
    return visit


class _Grid:
    """A base table cut into cells around pivots and into blocks of at most about ``BLOCK_ROWS`` rows.

    Pivots grow with the square root of the rows. Neighbouring cells share a block and a cell that is larger is cut by hash, so a
    query is copied at most once per block, whatever the number of cells; a block is copied once per ``BLOCK_ROWS`` queries sent to it.
    """

    def __init__(self, base: DataFrame, id_col: str, vector: str, radius: str | None):
        self.spark = spark = base.sparkSession
        self.id_col, self.vector = id_col, vector
        self.kind = _id_type(base, id_col)
        ball = F.lit(0.0) if radius is None else q(radius).cast("double")
        b = base.select(q(id_col).alias("id"), q(vector).cast("array<double>").alias("v"), ball.alias("ball"))
        rows, width, longest = b.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
        most = max(LEAST_PIVOTS, broadcast_bytes(spark) // (16 * max(width or 1, 1)))
        wanted = min(max(LEAST_PIVOTS, math.isqrt(rows)), MOST_PIVOTS, most)
        pivots = np.unique(np.array([r["v"] for r in bounded_sample(b.select("id", "v"), "id", wanted).collect()], dtype="float64").reshape(-1, width or 1), axis=0)
        pivots = pivots[locality_order(pivots)]

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), PIVOT_SLICE):
                    part = batch.iloc[start : start + PIVOT_SLICE]
                    m = _matrix(part["v"])
                    cell = _squared(m, pivots)[0].argmin(axis=1)
                    yield part.assign(cell=cell.astype("int32"), reach=_distance(m, pivots[cell]))

        placed = materialize(b.repartition(_parts(spark), "id").mapInPandas(assign, f"id {self.kind}, v array<double>, ball double, cell int, reach double"))
        stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("reach").alias("lo"), F.max("reach").alias("hi"), F.max("ball").alias("ball")).orderBy("cell").toPandas()
        first, pieces, self.blocks = packed_blocks(stats["n"].to_numpy(), BLOCK_ROWS)
        scale = float(longest or 0.0) + float((pivots * pivots).sum(axis=1).max(initial=0.0))
        self.cells = Cells(pivots[stats["cell"].to_numpy(dtype="int64")], stats["lo"].to_numpy(), stats["hi"].to_numpy(), stats["ball"].to_numpy(), first, pieces, scale + 1e-300)
        where = spark.createDataFrame(list(zip(stats["cell"].tolist(), range(len(stats)), first.tolist(), pieces.tolist())), "cell int, place int, first int, pieces int")
        cut = placed.join(F.broadcast(where), "cell")  # one row per pivot
        self.rows = cut.select("id", "v", "ball", F.col("place").alias("cell"), (F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))).cast("int").alias("block"))

    def _sent(self, queries: DataFrame, choose: Callable | None, limits: DataFrame | None = None, far: bool = False) -> DataFrame:
        """Queries once per block they must visit, that of their own cell alone without ``choose``: ``(id, v, home, limit, outside, block)``.

        ``outside`` is the least bound over the blocks not visited, infinite unless ``far`` asks for it.
        """
        cells, blocks = self.cells, self.blocks
        given = queries.select(q(self.id_col).alias("id"), q(self.vector).cast("array<double>").alias("v"))
        given = given.withColumn("limit", F.lit(float("inf"))) if limits is None else given.join(limits, "id", "left").fillna(float("inf"), ["limit"])

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), PIVOT_SLICE):
                    part = batch.iloc[start : start + PIVOT_SLICE].reset_index(drop=True)
                    d = cells.distances(_matrix(part["v"]))
                    home = d.argmin(axis=1)
                    if choose is None:
                        visit, outside = at_home(cells, home, blocks), np.full(len(home), np.inf)
                    else:
                        bounds = cells.lower_bounds(d, home=home)
                        visit = choose(cells, d, home, bounds, part["limit"].to_numpy())
                        outside = np.where(visit, np.inf, cells.by_block(bounds, blocks)).min(axis=1) if far else np.full(len(home), np.inf)
                    row, block = np.nonzero(visit)
                    yield part.iloc[row].assign(home=home[row].astype("int32"), outside=outside[row], block=block.astype("int32"))[["id", "v", "home", "limit", "outside", "block"]]

        schema = f"id {_id_type(given, 'id')}, v array<double>, home int, limit double, outside double, block int"
        return materialize(given.repartition(_parts(self.spark), "id").mapInPandas(send, schema))

    def home(self, queries: DataFrame) -> DataFrame:
        return self._sent(queries, None)

    def beyond_home(self, queries: DataFrame, limits: DataFrame) -> DataFrame:
        blocks = self.blocks

        def choose(cells, d, home, bounds, limit):
            return (cells.by_block(bounds, blocks) <= limit[:, None]) & ~at_home(cells, home, blocks)

        return self._sent(queries, choose, limits)

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        blocks = self.blocks

        def choose(cells, d, home, bounds, limit):
            near = np.argpartition(d, min(probes, d.shape[1]) - 1, axis=1)[:, :probes]
            first, pieces = cells.first[near], cells.pieces[near]
            visit = np.zeros((len(home), blocks), dtype=bool)
            for piece in range(int(pieces.max(initial=0))):
                row, at = np.nonzero(pieces > piece)
                visit[row, first[row, at] + piece] = True
            return visit

        return self._sent(queries, choose, far=True)

    def in_reach(self, queries: DataFrame) -> DataFrame:
        blocks = self.blocks

        def choose(cells, d, home, bounds, limit):
            return cells.by_block(bounds - cells.ball[None, :] * (1 + 1e-9), blocks) <= 0.0

        return self._sent(queries, choose)

    def search(self, visits: DataFrame, kernel: Callable, schema: str) -> DataFrame:
        """Every visit against its block: both sides are cut so that no task holds more than about ``BLOCK_ROWS`` rows of either."""
        cells = self.cells
        counts = {r["block"]: r["n"] for r in visits.groupBy("block").agg(F.count("*").alias("n")).collect()}  # one row per block
        slices = self.spark.createDataFrame([(b, max(1, -(-n // BLOCK_ROWS))) for b, n in sorted(counts.items())], "block int, slices int")
        left = visits.join(F.broadcast(slices), "block").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).select("id", "v", "home", "limit", "block", "slice")
        right = self.rows.join(F.broadcast(slices), "block").select("id", "v", "ball", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

        def block(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or held.empty:
                return _nothing(schema)
            held = held.sort_values("cell", kind="stable")
            found = kernel(cells, asked["id"].to_numpy(), _matrix(asked["v"]), asked["home"].to_numpy(), asked["limit"].to_numpy(), held["id"].to_numpy(), _matrix(held["v"]), held["ball"].to_numpy(), held["cell"].to_numpy())
            return found if len(found) else _nothing(schema)

        return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(block, schema)


def _nothing(schema: str) -> pd.DataFrame:
    return pd.DataFrame({part.split()[0]: [] for part in schema.split(", ")})


def _by_cell(cells: Cells, qm: np.ndarray, home: np.ndarray, b_cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(queries, cells, first row, nearest, bounds)`` of slices of the queries, those of one cell together: the cells of a block
    sorted by cell, which of them has the nearest pivot, and the bounds to all of them."""
    held, first = np.unique(b_cells, return_index=True)
    order = np.argsort(home, kind="stable")
    for start in range(0, len(qm), ASKED_SLICE):
        some = order[start : start + ASKED_SLICE]
        m, own = qm[some], home[some]
        d = np.sqrt(np.maximum(_squared(m, cells.pivots[held])[0], 0.0))
        yield some, held, first, d.argmin(axis=1), cells.lower_bounds(d, held, own, _distance(m, cells.pivots[own]))


def _nearest(k: int, skip_same_id: bool) -> Callable:
    """Search of a block: a query's nearest cell first, then cell by cell; it leaves out cells beyond its k-th distance so far."""

    def kernel(cells: Cells, q_ids, qm, home, limit, b_ids, bm, _balls, b_cells) -> pd.DataFrame:
        best = _Best(q_ids, qm, b_ids, bm, k, skip_same_id, limit)
        for some, _, first, nearest, bounds in _by_cell(cells, qm, home, b_cells):
            stops = np.r_[first[1:], len(b_cells)]
            own = np.arange(len(first))[None, :] == nearest[:, None]
            for others in (False, True):
                for c in np.argsort(bounds.min(axis=0), kind="stable"):
                    active = some[(own[:, c] != others) & (bounds[:, c] <= best.limit[some])]
                    for at in range(0, len(active), QUERY_SLICE):
                        best.look(active[at : at + QUERY_SLICE], int(first[c]), int(stops[c]))
        return best.frame()

    return kernel


def _inside_balls(cells: Cells, q_ids, qm, home, _limit, b_ids, bm, balls, b_cells) -> pd.DataFrame:
    """Counts of a block cell by cell; a query leaves out cells beyond the largest ball of their rows."""
    counts = np.zeros(len(q_ids), dtype="int64")
    for some, held, first, _, bounds in _by_cell(cells, qm, home, b_cells):
        stops = np.r_[first[1:], len(b_cells)]
        for c in range(len(held)):
            active = some[bounds[:, c] <= cells.ball[held[c]] * (1 + 1e-9)]
            for at in range(0, len(active), QUERY_SLICE):
                _count_inside(counts, qm, active[at : at + QUERY_SLICE], bm, balls, int(first[c]), int(stops[c]))
    hit = counts > 0
    return pd.DataFrame({"query_id": q_ids[hit], "n": counts[hit]})


def locality_order(points: np.ndarray) -> np.ndarray:
    """An order in which points near each other mostly follow each other: halves along the widest axis, again and again."""
    out: list[np.ndarray] = []
    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) <= 2:
            out.append(own)
            continue
        part = points[own]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = own[np.argsort(part[:, axis], kind="stable")]
        stack += [order[len(order) // 2 :], order[: len(order) // 2]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def packed_blocks(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(first block, number of blocks)`` per cell and the number of blocks: cells share a block in order, larger ones are cut."""
    first, pieces = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block, filled = 0, 0
    for k, n in enumerate(int(x) for x in sizes):
        if filled and filled + n > most:
            block, filled = block + 1, 0
        first[k] = block
        if n > most:
            pieces[k] = -(-n // most)
            block, filled = block + int(pieces[k]), 0
        else:
            filled += n
    return first, pieces, block + (1 if filled else 0)
