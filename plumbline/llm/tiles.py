"""Near-duplicate vectors by int8 tile products with error bounds.

Unit vectors are rounded to int8 with a scale of their own, and the length of the rounding error is kept. A pair's cosine then lies
within ``e1 + e2 + e1 * e2`` of the int8 product, so only pairs that may reach the threshold are computed in double precision.
Every block of vectors meets every block once, as one tile. The work is quadratic by nature; blocks grow with the input
up to a bound, which keeps the copies of a block few. A tile returns link counts and a spanning forest of its links, so copies in
thousands cost rows in proportion to their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, columns
from plumbline.llm.components import connected_components

LEAST_BLOCK, MOST_BLOCK = 1024, 65536
BLOCKS = 16  # blocks aimed at for small inputs
BLOCK_BYTES = 1 << 26
STEP = 1024  # side of the products inside a tile
EXACT_DIMS = 1024  # int8 products over so many dimensions are exact in float32
SLACK = 1e-6  # rounding of the float32 scaling and of the norms

PACKED = "serial long, dim int, count int, vec_id array<long>, quantised binary, scale binary, error binary, raw binary, wide boolean"


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row per row of ``vectors``.

    Two vectors link when their cosine, in double precision, is at least ``threshold`` (above 0). Vectors that are null, empty or
    zero or hold null or non-finite components link with nothing, as do vectors of different lengths and rows whose id is null
    (those have a null component and are not kept). Repeated rows are vectors of their own. ``component_id`` is the smallest id
    reachable by links, and ``kept`` says whether it is the row's own. Other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    with Scratch(vectors.sparkSession) as scratch:
        given = columns(vectors, vec_id=vec_id, embedding=embedding).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        wide = dict(given.dtypes)["embedding"] != "array<float>"
        rows = given.count()
        block = int(min(MOST_BLOCK, max(LEAST_BLOCK, rows // BLOCKS + 1)))
        dealt = given.repartition(max(1, -(-rows // block)), F.xxhash64("vec_id"))
        packed = scratch.keep(dealt.mapInArrow(_packer(block, wide), PACKED))
        full = packed.where("dim > 0")
        order = full.select("serial", F.expr("row_number() over (order by dim, serial)").cast("long").alias("block"))
        blocks = scratch.keep(full.join(order, "serial").drop("serial"))
        ranges = blocks.groupBy("dim").agg(F.min("block").alias("low"), F.max("block").alias("high"))
        copies = blocks.join(F.broadcast(ranges), "dim").withColumn("other", F.explode(F.sequence("low", "high")))
        tiles = copies.withColumn("row", F.least("block", "other")).withColumn("col", F.greatest("block", "other"))
        found = scratch.keep(tiles.groupBy("row", "col").applyInPandas(_tile(threshold), "a long, b long, links long"))
        component = scratch.keep(connected_components(found.where("b is not null").select("a", "b"), scratch))
        counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("n_links"))
        nodes = blocks.select("block", F.posexplode("vec_id").alias("pos", "vec_id")).select((F.col("block") * (1 << 32) + F.col("pos")).alias("node"), "vec_id")
        joined = nodes.join(counts.withColumnRenamed("a", "node"), "node", "left").join(component.withColumnRenamed("id", "node"), "node", "left")
        joined = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "node").alias("component"))
        joined = scratch.keep(joined, release=True)
        alone = scratch.keep(packed.where("dim = 0").select(F.explode("vec_id").alias("vec_id")), release=True)
    least = joined.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = joined.join(least, "component").select("vec_id", "n_links", "component_id")
    single = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(int8 rows, scale, length of the error)`` of unit vectors."""
    scale = np.abs(units).max(axis=1) / 127
    rounded = np.rint(units / scale[:, None])
    error = units - rounded * scale[:, None]
    return rounded.astype(np.int8), scale, np.sqrt(np.einsum("ij,ij->i", error, error)) + SLACK


def _packer(block: int, wide: bool):
    kind = np.float64 if wide else np.float32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        serial = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        nothing: list = []

        def flush(dim: int) -> pa.RecordBatch:
            ids, parts = held.pop(dim)
            raw = np.concatenate(parts)
            rows, scale, error = quantise(unit(raw))
            return record(dim, [int(x) for x in ids], rows.tobytes(), scale.tobytes(), error.tobytes(), raw.tobytes())

        def record(dim, ids, *binary) -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            cells = [pa.array([serial], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in binary], pa.array([wide])]
            return pa.RecordBatch.from_arrays(cells, names=["serial", "dim", "count", "vec_id", "quantised", "scale", "error", "raw", "wide"])

        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(kind)
            sizes = np.where(np.asarray(lists.is_null()) | np.array([x is None for x in ids], dtype=bool), 0, np.diff(offsets)) if ids else np.zeros(0, np.int64)
            good = np.zeros(len(ids), dtype=bool)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == dim)
                raw = values[offsets[at][:, None] + np.arange(dim)]
                fine = np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1)
                good[at[fine]] = True
                most = max(1, min(block, BLOCK_BYTES // (dim * raw.itemsize)))
                at, raw = at[fine], raw[fine]
                for start in range(0, len(at), most):
                    own = held.setdefault(dim, ([], []))
                    own[0].extend(ids[k] for k in at[start : start + most])
                    own[1].append(raw[start : start + most])
                    if len(own[0]) >= most:
                        yield flush(dim)
            nothing.extend(x for x, ok in zip(ids, good.tolist()) if not ok)
            if len(nothing) > MOST_BLOCK:
                yield record(0, nothing, b"", b"", b"", b"")
                nothing = []
        for dim in list(held):
            yield flush(dim)
        if nothing:
            yield record(0, nothing, b"", b"", b"", b"")

    return pack


class Forest:
    """Components of the vectors of one tile; every link ends in an update of ``label``."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                above = label[label]
                if (above == label).all():
                    break
                label[:] = above


def _tile(threshold: float):
    class Side:
        def __init__(self, row):
            self.n, dim = int(row["count"]), int(row["dim"])
            self.first = int(row["block"]) << 32
            self.rows = np.frombuffer(row["quantised"], np.int8).reshape(self.n, dim)
            self.scale = np.frombuffer(row["scale"], np.float64)
            self.error = np.frombuffer(row["error"], np.float64)
            self.raw = np.frombuffer(row["raw"], np.float64 if row["wide"] else np.float32).reshape(self.n, dim)

    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if x.shape[1] <= EXACT_DIMS:
            return x.astype(np.float32) @ y.astype(np.float32).T
        total = np.zeros((len(x), len(y)))
        for k in range(0, x.shape[1], EXACT_DIMS):
            total += x[:, k : k + EXACT_DIMS].astype(np.float32) @ y[:, k : k + EXACT_DIMS].astype(np.float32).T
        return total

    def exact(left: Side, right: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs reach the threshold, in double precision."""
        ui, at_i = np.unique(i, return_inverse=True)
        uj, at_j = np.unique(j, return_inverse=True)
        x, y = unit(left.raw[ui]), unit(right.raw[uj])
        if len(ui) * len(uj) <= 16 * len(i) + 4096:
            return (x @ y.T)[at_i, at_j] >= threshold
        parts = [np.einsum("ij,ij->i", x[at_i[k : k + 65536]], y[at_j[k : k + 65536]]) for k in range(0, len(i), 65536)]
        return np.concatenate(parts) >= threshold

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sides = [Side(r) for _, r in part.drop_duplicates("block").sort_values("block").iterrows()]
        left, right, same = sides[0], sides[-1], len(sides) == 1
        links = [np.zeros(left.n, np.int64), np.zeros(right.n, np.int64)]
        forest = Forest(left.n + (0 if same else right.n))
        shift = 0 if same else left.n
        for a in range(0, left.n, STEP):
            x, sx, ex = left.rows[a : a + STEP], left.scale[a : a + STEP], left.error[a : a + STEP]
            for b in range(a if same else 0, right.n, STEP):
                y, sy, ey = right.rows[b : b + STEP], right.scale[b : b + STEP], right.error[b : b + STEP]
                dots = product(x, y)
                most = ey.max()
                room = threshold - ex - most - ex * most - SLACK
                floor = np.where(room > 0, room / (sx * sy.max()), room / (sx * sy.min()))
                i, j = np.nonzero(dots >= (floor * (1 - SLACK * np.sign(floor))).astype(np.float32)[:, None])
                if same and a == b:
                    i, j = i[i < j], j[i < j]
                near = dots[i, j] * (sx[i] * sy[j]) >= threshold - ex[i] - ey[j] - ex[i] * ey[j] - SLACK
                i, j = i[near], j[near]
                if not len(i):
                    continue
                hit = exact(left, right, a + i, b + j)
                i, j = a + i[hit], b + j[hit]
                links[0] += np.bincount(i, minlength=left.n)
                links[0 if same else 1] += np.bincount(j, minlength=right.n)
                forest.add(i, j + shift)
        node = left.first + np.arange(left.n) if same else np.r_[left.first + np.arange(left.n), right.first + np.arange(right.n)]
        count = links[0] if same else np.r_[links[0], links[1]]
        some, hung = np.flatnonzero(count), np.flatnonzero(forest.label != np.arange(len(node)))
        counted = pd.DataFrame({"a": node[some], "b": pd.array([pd.NA] * len(some), dtype="Int64"), "links": count[some]})
        joined = pd.DataFrame({"a": node[hung], "b": pd.array(node[forest.label[hung]], dtype="Int64"), "links": np.zeros(len(hung), np.int64)})
        return pd.concat([counted, joined])

    return run
