"""N-gram Jaccard join by vertical partitioning of the n-gram order.

Shingles are hashed to 64 bits and the hash range is the global order that is cut into fragments.

1. Documents with the same shingle set form a class; one of them stands for it.
2. A document can only have a partner if at most a quarter (for 0.75) of its shingles occur in no other document. Each
   fragment of the lower part of the order counts those of its own range, and the counts are summed per document. This
   drops nearly all documents without a partner and no other: a chance collision of the shortened keys only keeps one more.
3. For the classes left, shingles found once more go. Classes with the same repeated shingles differ in size alone, so those
   close enough hang on the smallest of them, and the rest can only reach the group through it.
4. Rarest-first prefixes give candidate pairs, first only with the most repetitive class that holds the same shingle. Pairs inside a
   component found so far need no test; all other candidates follow. So a group of near copies costs links in proportion
   to its size, and no pair that could join two components is left out.
5. For candidate pairs the overlap of each fragment is counted by itself and the counts are summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, columns, freed, small_side
from plumbline.llm.components import connected_components
from plumbline.llm.shingles import WIDTH, mix, shingle_sets

LOWER_PART = 0.4  # share of the shingle order used by step 2; above 1 - similarity
SLICE_DOCS = 4096
SLICE_GRAMS = 1 << 18
FRAGMENT_GRAMS = 1 << 20  # shingles of one fragment of step 2; their number follows the data
LEAST_FRAGMENTS = 64
PAIR_FRAGMENTS = 4
SEVERAL = 0xFFFF

SLICES = "slice long, doc_id array<long>, row array<long>, n array<long>, cls array<long>, keys binary, owners binary"


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, width: int = WIDTH, row: str | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row per row of ``docs``; with ``row`` also ``row`` and ``kept``.

    ``row`` names a column of whole numbers that tells rows of equal id apart. ``kept`` then holds for the smallest (id, row) of each
    component and for rows that link with nothing.

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their shingle sets. ``component_id`` is the
    smallest id reachable by links. Null and blank texts have no shingles and link with nothing. A row whose id is null
    links with nothing and has a null component. Repeated rows are copies and come back each; rows that share an id but not
    a text are separate documents. Other columns of ``docs`` are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        given = columns(docs, doc_id=doc_id, text=text, **({"row": row} if row else {}))
        given = given.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("row").cast("long").alias("row") if row else F.lit(0).cast("long").alias("row"))
        cut = scratch.keep(given.mapInArrow(freed(_slicer(width)), SLICES))
        rows = cut.select(F.inline(F.arrays_zip("doc_id", "row", "n", "cls")))
        alive = scratch.keep(_not_alone(cut, percent))
        classes = rows.join(alive.where("alive").select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
        classes = scratch.keep(classes.where("doc_id is not null"))
        shared = scratch.keep(_repeated_grams(given, classes, width))
        component = _components(shared, scratch, percent)
        found = scratch.keep(rows.join(component, "cls", "left").select("doc_id", "row", "n", F.coalesce("component", "cls").alias("component")), release=True)
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    least = found.where(linked).groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    empty = found.where(~linked).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row", F.lit(True).alias("kept"))
    kept = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("row") == F.col("least.row"))
    every = found.where(linked).join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), "row", kept.alias("kept")).unionByName(empty)
    return every if row else every.drop("row", "kept")


def _signature(grams: np.ndarray) -> np.int64:
    """Hash of a set: the sum of its mixed members, mixed again with their number."""
    total = mix(grams + np.uint64(0x51ED2701)).sum(dtype=np.uint64)
    return mix(np.array([total ^ np.uint64(len(grams))], dtype=np.uint64)).view(np.int64)[0]


def _slicer(width: int):
    top = np.uint64(int(LOWER_PART * 2.0**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        ids, own, sizes, classes, low, held = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            keys = np.concatenate(low) if low else np.zeros(0, np.uint64)
            owners = np.repeat(np.arange(len(low), dtype=np.uint16), [len(x) for x in low])
            order = np.argsort(keys, kind="stable")
            keys, owners = keys[order], owners[order]
            if len(keys):
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                times = np.diff(np.r_[first, len(keys)])
                keys, owners = keys[first], np.where(times > 1, np.uint16(SEVERAL), owners[first])
            out = pa.RecordBatch.from_pydict(
                {
                    "slice": pa.array([number], pa.int64()),
                    "doc_id": pa.array([ids[:]], pa.list_(pa.int64())),
                    "row": pa.array([own[:]], pa.list_(pa.int64())),
                    "n": pa.array([sizes[:]], pa.list_(pa.int64())),
                    "cls": pa.array([classes[:]], pa.list_(pa.int64())),
                    "keys": pa.array([keys.tobytes()], pa.binary()),
                    "owners": pa.array([owners.astype(np.uint16).tobytes()], pa.binary()),
                }
            )
            number, held = number + 1, 0
            for x in (ids, own, sizes, classes, low):
                x.clear()
            return out

        for batch in batches:
            names, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, grams in shingle_sets(batch.column(1), width):
                ids.append(names[row])
                own.append(rows[row])
                sizes.append(len(grams))
                classes.append(int(_signature(grams)))
                low.append(grams[: int(np.searchsorted(grams, top))])
                held += len(low[-1])
                if len(ids) >= SLICE_DOCS or held >= SLICE_GRAMS:
                    yield flush()
        if ids:
            yield flush()

    return run


def _not_alone(cut: DataFrame, percent: int) -> DataFrame:
    """``(cls, alive)``: false where too many shingles of the lower part occur in one document only."""
    total = cut.select(F.sum(F.length("keys") / 8)).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, int(total // FRAGMENT_GRAMS) + 1)
    span = int(LOWER_PART * 2.0**64) // fragments + 1

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(max(0, span.bit_length() - 32))
        for batch in batches:
            for number, keys, owners in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                keys = np.frombuffer(keys.as_py(), dtype=np.uint64)
                owners = np.frombuffer(owners.as_py(), dtype=np.uint16)
                at = (keys // np.uint64(span)).astype(np.int64)
                short = ((keys - at.astype(np.uint64) * np.uint64(span)) >> shift).astype(np.uint32)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
                stop = np.r_[first[1:], len(at)] if len(at) else first
                yield pa.RecordBatch.from_pydict(
                    {
                        "fragment": pa.array(at[first], pa.int64()),
                        "slice": pa.array([number] * len(first), pa.int64()),
                        "keys": pa.array([short[a:b].tobytes() for a, b in zip(first, stop)], pa.binary()),
                        "owners": pa.array([owners[a:b].tobytes() for a, b in zip(first, stop)], pa.binary()),
                    }
                )

    def single(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(part["keys"]), dtype=np.uint32)
        owners = np.frombuffer(b"".join(part["owners"]), dtype=np.uint16)
        sizes = part["owners"].str.len().to_numpy() // 2
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        change = np.r_[True, ordered[1:] != ordered[:-1], True]
        once = order[change[1:] & change[:-1]]
        once = np.sort(once[owners[once] != SEVERAL])
        edges = np.searchsorted(once, np.r_[0, np.cumsum(sizes)])
        packed = [owners[once[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pd.DataFrame({"slice": part["slice"], "owners": packed})

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        head = part[part["n"].notna()].iloc[0]
        n = np.asarray(head["n"], dtype=np.int64)
        single = np.frombuffer(b"".join(part.loc[part["n"].isna(), "owners"]), dtype=np.uint16)
        alone = np.bincount(single, minlength=len(n))
        return pd.DataFrame({"cls": np.asarray(head["cls"], dtype=np.int64), "alive": (n > 0) & (100 * alone <= (100 - percent) * n)})

    parts = cut.select("slice", "keys", "owners").mapInArrow(freed(cut_up), "fragment long, slice long, keys binary, owners binary")
    counts = parts.groupBy("fragment").applyInPandas(single, "slice long, owners binary").where(F.length("owners") > 0)
    heads = cut.select("slice", F.lit(None).cast("binary").alias("owners"), "n", "cls")
    nothing = F.lit(None).cast("array<long>")
    return heads.unionByName(counts.select("slice", "owners", nothing.alias("n"), nothing.alias("cls"))).groupBy("slice").applyInPandas(summed, "cls long, alive boolean")


def _repeated_grams(given: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``(cls, n, gram, df)``: shingles that at least two of the classes hold."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            for row, grams in shingle_sets(batch.column(1), width):
                if int(_signature(grams)) == wanted[row]:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "cls": pa.array([wanted[row]], pa.int64()),
                            "n": pa.array([len(grams)], pa.int64()),
                            "grams": pa.array([grams.view(np.int64)], pa.list_(pa.int64())),
                        }
                    )

    wanted = small_side(classes.select("doc_id", "cls"), classes.count(), 16)
    sets = given.join(wanted, "doc_id").select("cls", "text").mapInArrow(freed(shingle), "cls long, n long, grams array<long>").dropDuplicates(["cls"])
    grams = sets.select("cls", "n", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    return grams.join(often, "gram").select("cls", "n", "gram", "df")


def _components(shared: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """``(cls, component)`` of the classes that link with another one."""
    more = 100 - percent
    per_class = shared.groupBy("cls", "n").agg(F.count("*").alias("s"), F.sum(F.log2("df")).alias("weight"), F.bit_xor(F.xxhash64("gram")).alias("x"), F.bit_xor(F.xxhash64("gram", F.lit(1))).alias("y"))
    per_class = scratch.keep(per_class.where(100 * (F.col("n") - F.col("s")) <= more * F.col("n")))
    # classes with the same repeated shingles: those that link with the smallest one hang on it
    least = per_class.groupBy("x", "y", "s").agg(F.min(F.struct("n", "cls")).alias("least"))
    group = per_class.join(least, ["x", "y", "s"]).select("cls", "n", "s", "weight", F.col("least.cls").alias("rep"), F.col("least.n").alias("rep_n"))
    hangs = (F.col("cls") != F.col("rep")) & _similar(F.col("s"), F.col("n"), F.col("rep_n"), percent)
    group = scratch.keep(group.withColumn("hangs", hangs))
    hung = group.where("hangs").select(F.col("cls").alias("a"), F.col("rep").alias("b"))

    nodes = group.where("not hangs").select("cls", "s", (F.col("weight") / F.col("n")).alias("score"))
    rank = F.expr("row_number() over (partition by cls order by df, gram)")
    prefix = shared.join(nodes, "cls").withColumn("pos", rank + F.col("n") - F.col("s") - 1).where(100 * F.col("pos") <= more * F.col("n"))
    prefix = scratch.keep(prefix.select("gram", "cls", "n", "pos", "score"))
    # step 4, first with the most repetitive class of each list
    hub = prefix.groupBy("gram").agg(F.max_by(F.struct("cls", "n", "pos"), F.struct("score", "cls")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    near = prefix.join(hub, "gram").where(F.col("cls") != F.col("hub.cls"))
    near = near.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("hub.cls").alias("b"), F.col("hub.n").alias("nb"), F.col("hub.pos").alias("pb"))
    first = _linked(near, shared, scratch, percent)
    component = scratch.keep(connected_components(hung.unionByName(first), scratch))

    placed = prefix.join(component.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("gram")
    placed = scratch.keep(placed.join(mixed, "gram", "left_semi").select("gram", "cls", "n", "pos", "component"))
    left = placed.select("gram", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"))
    right = placed.select("gram", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"))
    rest = left.join(right, (left["gram"] == right["gram"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _possible(percent)).select("a", "na", "pa", "b", "nb", "pb")
    second = _linked(rest, shared, scratch, percent)
    every = scratch.keep(hung.unionByName(first).unionByName(second)) if not second.isEmpty() else None
    final = component if every is None else connected_components(every, scratch)
    return final.select(F.col("id").alias("cls"), "component")


def _similar(overlap: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (na + nb - overlap)


def _possible(percent: int) -> Column:
    """Sizes and the places of a common shingle leave room for enough overlap."""
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return _similar(most, F.col("na"), F.col("nb"), percent)


def _linked(pairs: DataFrame, shared: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links ``(a, b)`` among candidate pairs: overlaps counted by fragment, then summed per pair."""
    low, high = F.col("a") < F.col("b"), F.col("a") > F.col("b")
    pairs = pairs.where(_possible(percent)).select(
        F.least("a", "b").alias("a"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(high, F.col("na")).otherwise(F.col("nb")).alias("nb")
    )
    pairs = scratch.keep(pairs.distinct())
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    fragment = F.pmod(F.shiftrightunsigned("gram", 32), F.lit(PAIR_FRAGMENTS))
    segment = shared.join(ends, "cls", "left_semi").groupBy("cls", fragment.alias("fragment")).agg(F.collect_list("gram").alias("grams"))
    segment = scratch.keep(segment)
    left = segment.select(F.col("cls").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segment.select(F.col("cls").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "na", "b", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    overlap = partial.groupBy("a", "na", "b", "nb").agg(F.sum("part").alias("overlap"))
    return scratch.keep(overlap.where(_similar(F.col("overlap"), F.col("na"), F.col("nb"), percent)).select("a", "b"))
