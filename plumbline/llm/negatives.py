"""Hard negatives by the threshold algorithm over sorted lists per dimension.

Vectors become whole numbers and are packed into blocks; a block holds, for every dimension, its rows in the order of that component.
A search for an anchor walks all lists at once, from the top where the anchor's component is positive and from the bottom where it is
negative. Each row met is scored in full by whole numbers. No row still unmet can score more than the sum of the anchor's components
times the values last met, so the search ends once that sum lies strictly below what every window asks for.
Two rounds run block by block: the first finds each anchor's positives, the second fills the score windows these set. A block returns
a few rows per anchor and window, and the best of all blocks are ranked in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, columns

LEAST_BLOCK, MOST_BLOCK = 1024, 32768
BLOCKS = 16  # blocks aimed at for small inputs
BLOCK_CELLS = 1 << 21  # components in a block
ANCHORS = 65536  # anchors that one task takes through a block
FIRST_DEPTH = 8  # entries read of every list before the first test

BLOCK = "dim int, block int, known int, vec_id array<long>, label array<long>, row array<long>, anchors array<int>, kind string, parts binary, lists binary"
CHOSEN = "dim int, source int, vec_id array<long>, label array<long>, row array<long>, parts binary"
FOUND = "row long, anchor_id long, positive_score long, vec_id long, score long"

Windows = list[tuple[int | None, int | None]]


def hard_negatives(
    vectors: DataFrame,
    anchor: Column | str,
    vec_id: str = "vec_id",
    label: str = "label",
    embedding: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A component x becomes floor(``scale`` * x); the score of two rows is the inner product of these. Rows where ``anchor`` holds, a
    condition on ``vec_id`` and ``label``, are anchors. An anchor's positives are its ``positives`` best other rows of its label. For
    each, the ``negatives`` best rows of another label are returned whose score is at least ``low`` and at most ``high`` percent of
    the positive's. Higher scores come first, ties by smaller id, a null id last.

    Rows whose label or vector is null, or that hold a null or non-finite component, take no part. A row with a null id is never an
    anchor. Vectors of different lengths do not score each other; empty vectors score 0. Repeated rows are rows of their own: a copy
    of an anchor is another row. Zero anchors score 0 with all. An anchor without positives, or a positive without a negative in its
    window, has no rows in the result. Scores that may not fit 64 bits raise an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    given = columns(vectors, vec_id=vec_id, label=label, embedding=embedding)
    given = given.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = given.where("label is not null and embedding is not null").where(~bad)
    condition = F.expr(anchor) if isinstance(anchor, str) else anchor
    given = given.withColumn("anchor", F.coalesce(condition & F.col("vec_id").isNotNull(), F.lit(False)))
    rows, dims = given.agg(F.count("*"), F.max(F.size("embedding"))).first()
    most = max(256, min(MOST_BLOCK, BLOCK_CELLS // max(dims or 1, 1)))
    blocks_n = max(1, -(-rows // min(most, max(LEAST_BLOCK, rows // BLOCKS + 1))))
    with Scratch(spark) as scratch:
        blocks = scratch.keep(given.repartition(blocks_n).mapInArrow(_packer(scale), BLOCK))
        chosen = scratch.keep(blocks.where(F.size("anchors") > 0).mapInArrow(_choose, CHOSEN))
        count = chosen.agg(F.sum(F.size("row"))).first()[0] or 0
        chunks_n = max(1, -(-count // ANCHORS))
        searched = blocks.select("dim", "block", "known", "vec_id", "label", "row", "kind", "parts", "lists")
        searched = searched.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks_n - 1)))).groupBy("dim", "block", "chunk")

        def tiles(queries: DataFrame, same: bool, best: int) -> DataFrame:
            """The best rows of every block for every window, then the best of all blocks."""
            spread = queries.withColumn("chunk", F.pmod("source", F.lit(chunks_n))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks_n - 1))))
            found = searched.cogroup(spread.groupBy("dim", "block", "chunk")).applyInPandas(_tile(same, best, low, high), FOUND)
            order = Window.partitionBy("row", "positive_score").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
            return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)

        nothing = F.array().cast("array<bigint>")
        near = scratch.keep(tiles(chosen.select("*", nothing.alias("asking"), nothing.alias("asked")), True, positives).select("row", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        own = chosen.select("dim", "source", F.explode("row").alias("row"))
        asked = own.join(near.select("row", "positive_score").distinct(), "row").groupBy("dim", "source").agg(F.collect_list(F.struct("row", "positive_score")).alias("asked"))
        windows = asked.select("dim", "source", F.col("asked.row").alias("asking"), F.col("asked.positive_score").alias("asked"))
        far = tiles(chosen.join(windows, ["dim", "source"]), False, negatives)
        far = far.select("row", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        joined = near.join(far, ["row", "positive_score"])
        return scratch.keep(joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), release=True)


def _packer(scale: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            ids, labels, lists, marks = (batch.column(k) for k in range(4))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(offsets)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                whole = np.floor(scale * values[offsets[at][:, None] + np.arange(dim)])
                if np.abs(whole).max(initial=0) >= 2.0**62:
                    raise OverflowError("scores of these components do not fit 64 bits")
                take = pa.array(at)
                known = np.asarray(ids.take(take).is_valid())
                held.setdefault(dim, []).append(
                    (ids.take(take).fill_null(0).to_numpy(zero_copy_only=False), known, labels.take(take).to_numpy(zero_copy_only=False), marks.take(take).to_numpy(zero_copy_only=False), whole.astype(np.int64))
                )
        number = TaskContext.get().partitionId()
        start = number << 32
        for dim in sorted(held):
            ids, known, labels, marks, whole = (np.concatenate(x) for x in zip(*held.pop(dim)))
            order = np.lexsort((ids, ~known))  # positions follow ids, so that ties of scores fall to the smaller position
            ids, known, labels, marks, whole = ids[order], known[order], labels[order], marks[order], whole[order]
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(whole).max(initial=0) <= np.iinfo(k).max)
            lists = np.argsort(whole, axis=0, kind="stable").T
            rows = np.arange(start, start + len(ids))
            start += len(ids)
            cells = [
                pa.array([dim], pa.int32()), pa.array([number], pa.int32()), pa.array([int(known.sum())], pa.int32()), pa.array([ids.tolist()], pa.list_(pa.int64())),
                pa.array([labels.tolist()], pa.list_(pa.int64())), pa.array([rows.tolist()], pa.list_(pa.int64())), pa.array([np.flatnonzero(marks).tolist()], pa.list_(pa.int32())),
                pa.array([kind]), pa.array([whole.astype(kind).tobytes()], pa.binary()), pa.array([lists.astype("<u4" if len(ids) > 65536 else "<u2").tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cells, names=[x.split()[0] for x in BLOCK.split(", ")])

    return pack


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of every block, as one row per block."""
    for batch in batches:
        for k in range(batch.num_rows):
            dim, block, _, ids, labels, rows, marks, kind, parts = (batch.column(c)[k].as_py() for c in range(9))
            whole = np.frombuffer(parts, kind).reshape(len(ids), dim)[marks].astype("<i8")
            cells = [pa.array([dim], pa.int32()), pa.array([block], pa.int32()), *[pa.array([[x[m] for m in marks]], pa.list_(pa.int64())) for x in (ids, labels, rows)], pa.array([whole.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=[x.split()[0] for x in CHOSEN.split(", ")])


def threshold_search(parts: np.ndarray, lists: np.ndarray, anchor: np.ndarray, fits: np.ndarray, windows: Windows, best: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, ``(positions, scores)`` of the ``best`` rows among those that fit, ties to smaller positions.

    ``parts`` holds a row of whole numbers per row of the block, ``lists`` per dimension the positions in ascending order of the component.
    """
    n = len(parts)
    used = np.flatnonzero(anchor)
    weights = anchor[used]
    unmet = np.ones(n, dtype=bool)
    positions, scores = [], []
    depth, step = 0, FIRST_DEPTH
    left = n
    while left:
        if not len(used) or step * len(used) >= left:  # no list to walk, or the rest costs no more than the next round of sorted access
            fresh = np.flatnonzero(unmet)
        else:
            at = np.arange(depth, depth + step)
            met = lists[used[:, None], np.where(weights[:, None] > 0, n - 1 - at, at)].ravel()
            fresh = np.unique(met[unmet[met]])
        unmet[fresh] = False
        left -= len(fresh)
        fresh = fresh[fits[fresh]]
        positions.append(fresh)
        scores.append(parts[fresh] @ anchor)
        if not left:
            break
        depth += step
        step = depth
        last = lists[used, np.where(weights > 0, n - depth, depth - 1)]
        threshold = int((parts[last, used] * weights).sum())
        got = np.concatenate(scores)
        if all(_settled(got, low, high, best, threshold) for low, high in windows):
            break
    where, got = np.concatenate(positions or [np.zeros(0, np.int64)]), np.concatenate(scores or [np.zeros(0, np.int64)])
    out = []
    for low, high in windows:
        inside = _inside(got, low, high)
        own, value = where[inside], got[inside]
        first = np.lexsort((own, -value))[:best]
        out.append((own[first], value[first]))
    return out


def _inside(scores: np.ndarray, low: int | None, high: int | None) -> np.ndarray:
    inside = np.ones(len(scores), dtype=bool)
    if low is not None:
        inside &= scores >= low
    if high is not None:
        inside &= scores <= high
    return inside


def _settled(scores: np.ndarray, low: int | None, high: int | None, best: int, threshold: int) -> bool:
    """No unmet row can enter the window's best rows."""
    if low is not None and threshold < low:
        return True
    inside = scores[_inside(scores, low, high)]
    return len(inside) >= best and threshold < int(np.partition(inside, len(inside) - best)[len(inside) - best])


def _tile(same: bool, best: int, low: int, high: int):
    names = [x.split()[0] for x in FOUND.split(", ")]
    empty = pd.DataFrame({n: pd.Series(dtype="Int64") for n in names})

    def tile(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if block.empty or queries.empty:
            return empty
        given = block.iloc[0]
        ids, dim, known = given["vec_id"], int(given["dim"]), int(given["known"])
        n = len(ids)
        parts = np.frombuffer(given["parts"], given["kind"]).reshape(n, dim).astype(np.int64)
        lists = np.frombuffer(given["lists"], "<u4" if n > 65536 else "<u2").reshape(dim, n)
        labels, rows = np.asarray(given["label"], dtype=np.int64), np.asarray(given["row"], dtype=np.int64)
        largest = int(np.abs(parts).max(initial=0))
        out: list[tuple] = []
        for query in queries.itertuples():
            anchors = np.frombuffer(query.parts, "<i8").reshape(len(query.row), dim)
            if dim * largest * int(np.abs(anchors).max(initial=0)) >= 2**63:
                raise OverflowError("scores of these components do not fit 64 bits")
            asked: dict[int, list[int]] = {}
            for row, score in zip(query.asking.tolist(), query.asked.tolist()):
                asked.setdefault(row, []).append(score)
            for row, own_id, own_label, anchor in zip(query.row, query.vec_id, query.label, anchors):
                if same:
                    windows: Windows = [(None, None)]
                    marks: list[int | None] = [None]
                else:
                    marks = list(asked.get(int(row), ()))
                    windows = [(-(-low * s // 100), high * s // 100) for s in marks]
                if not windows:
                    continue
                fits = ((labels == own_label) & (rows != row)) if same else labels != own_label
                for mark, (where, scores) in zip(marks, threshold_search(parts, lists, anchor, fits, windows, best)):
                    out.extend((int(row), int(own_id), mark, int(ids[k]) if k < known else None, int(s)) for k, s in zip(where.tolist(), scores.tolist()))
        if not out:
            return empty
        return pd.DataFrame({name: pd.array(x, dtype="Int64") for name, x in zip(names, zip(*out))})

    return tile
