"""Delimited text with line breaks inside quotes, read by many tasks.

Spark splits a text file into blocks of lines. Whether a line begins inside quotes depends on everything before it, so a first pass
reduces each block to what it does to that state: leave it, set it, or turn it over. Running totals over the blocks of a file give the
state each block begins in. The second pass cuts records inside blocks; only a record that crosses blocks is put together from
its parts by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.session import materialize

QUOTE = '"'
FLUSH_BYTES = 8 << 20  # of records in one batch

BLOCK = "file long, start long, file_name string, from_outside boolean, from_inside boolean, blank boolean"
PART = "file long, start long, kind string, heading boolean, record string"


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether the end of ``line`` lies inside quotes. Quotes open only at the start of a cell; a doubled one stands for itself; what
    follows a closing quote belongs to the cell up to the separator."""
    if QUOTE not in line:
        return inside
    at = 0
    if not inside:
        if line[0] == QUOTE:
            at = 1
        else:
            at = line.find(sep + QUOTE)
            if at < 0:
                return False
            at += len(sep) + 1
    while True:
        at = line.find(QUOTE, at)
        if at < 0:
            return True
        if line.startswith(QUOTE, at + 1):
            at += 2
            continue
        # closed: on to the next cell that opens with a quote
        at += 1
        if line.startswith(sep + QUOTE, at):
            at += len(sep) + 1
            continue
        at = line.find(sep, at)
        at = line.find(sep + QUOTE, at) if at >= 0 else -1
        if at < 0:
            return False
        at += len(sep) + 1


def records(spark: SparkSession, paths: str | Sequence[str], sep: str = ",") -> DataFrame:
    """``(file_name, heading, record)``: the records of delimited files as text, without the line break that ends them.

    ``heading`` marks the first record of a file that is not empty. Empty records are left out. Lines end in a line feed, with or
    without a carriage return before it. A compressed file is read by one task. A quote that is never closed makes one record of the
    rest of its file, without the file's last line break. Line breaks inside quotes stay as they are written.
    """
    lines = spark.read.text(paths, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.col("_metadata.file_name").alias("file_name")
    )
    blocks = materialize(lines.mapInArrow(_reduce(sep), BLOCK))
    # one entry per block that Spark cut the files into, fewer than the tasks the driver plans
    begins = {(r["file"], r["start"]): (r["inside"], r["heads"]) for r in _states(blocks).collect()}
    parts = materialize(lines.drop("file_name").mapInArrow(_cut(sep, spark.sparkContext.broadcast(begins)), PART))
    whole = parts.where("kind = 'whole'").select("file", "heading", "record")
    torn = parts.where("kind <> 'whole'")
    order = W.partitionBy("file").orderBy("start", F.col("kind") == "begins")
    torn = torn.withColumn("origin", F.last(F.when(F.col("kind") == "begins", F.col("start")), ignorenulls=True).over(order))
    joined = torn.groupBy("file", "origin").agg(F.bool_or("heading").alias("heading"), F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"))
    mended = joined.select("file", "heading", F.regexp_replace(F.array_join(F.col("parts.record"), "\n"), "\r$", "").alias("record"))
    names = blocks.groupBy("file").agg(F.first("file_name").alias("file_name"))
    return whole.unionByName(mended).where("record <> ''").join(names, "file").select("file_name", "heading", "record")


def _states(blocks: DataFrame) -> DataFrame:
    """``(file, start, inside, heads)``: whether a block begins inside quotes and whether the file's heading begins in it.

    A block sets the state (both ways agree), turns it over, or leaves it; the last one that set it and the turns since then decide.
    """
    ordered = W.partitionBy("file").orderBy("start")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    agree = F.col("from_outside") == F.col("from_inside")
    turned = blocks.withColumn("turned", F.sum(F.when(~agree & F.col("from_outside"), 1).otherwise(0)).over(ordered))
    base = F.last(F.when(agree, F.struct(F.col("from_outside").alias("value"), "turned")), ignorenulls=True).over(before)
    state = turned.withColumns({"base": base, "count": F.coalesce(F.last("turned").over(before), F.lit(0))})
    odd = (F.col("count") - F.coalesce(F.col("base.turned"), F.lit(0))) % 2 == 1
    heads = F.col("start") == F.min(F.when(~F.col("blank"), F.col("start"))).over(W.partitionBy("file"))
    return state.select("file", "start", (F.coalesce(F.col("base.value"), F.lit(False)) != odd).alias("inside"), F.coalesce(heads, F.lit(False)).alias("heads"))


def read_quoted(spark: SparkSession, paths: str | Sequence[str], sep: str = ",") -> DataFrame:
    """All columns as text, named by the header of the first file, and ``file_name``: what Spark's reader gives when one task reads a file."""
    names = spark.read.csv(paths, sep=sep, header=True, escape=QUOTE, multiLine=True).columns
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    options = {"sep": sep, "escape": QUOTE, "multiLine": "true", "maxCharsPerColumn": "-1"}
    found = records(spark, paths, sep).where("not heading")
    cells = found.select("file_name", F.from_csv("record", F.lit(schema), options).alias("cells"))
    return cells.select(*[F.col("cells")[n].alias(n) for n in names], "file_name")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Stretches of lines of one block."""
    for batch in batches:
        files, starts = batch.column("file").to_numpy(), batch.column("start").to_numpy()
        at = 0
        while at < batch.num_rows:
            same = (files[at:] == files[at]) & (starts[at:] == starts[at])
            n = len(same) if same.all() else int(same.argmin())
            yield (int(files[at]), int(starts[at])), batch.slice(at, n)
            at += n


def _reduce(sep: str):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        for key, run in _runs(batches):
            state = seen.setdefault(key, [False, True, True, run.column("file_name")[0].as_py()])
            values = run.column("value")
            if state[2]:
                state[2] = not pc.any(pc.not_equal(pc.utf8_trim(values, "\r"), "")).as_py()
            for line in pc.filter(values, pc.match_substring(values, QUOTE)).to_pylist():
                line = line.rstrip("\r")
                state[0], state[1] = inside_after(line, state[0], sep), inside_after(line, state[1], sep)
        if seen:
            files, starts = zip(*seen)
            outside, within, blank, names = zip(*seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(starts, pa.int64()), pa.array(names), pa.array(outside), pa.array(within), pa.array(blank)], names=[x.split()[0] for x in BLOCK.split(", ")])

    return reduce


def _cut(sep: str, begins):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, str, bool, str]] = []
        size = 0
        key: tuple[int, int] | None = None
        inside = heading = continued = False
        held: list[str] = []

        def put(kind: str, record: str, heads: bool) -> None:
            nonlocal size
            out.append((*key, kind, heads, record))
            size += len(record) + 64

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            cells = zip(*out)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, kinds)], names=[x.split()[0] for x in PART.split(", ")])
            out, size = [], 0
            return batch

        def close() -> None:
            """The block ended: what is still open goes on in the next one."""
            if held:
                put("continues" if continued else "begins", "\n".join(held), heading and not continued)

        for own, run in _runs(batches):
            if own != key:
                close()
                key, held = own, []
                inside, heading = begins.value[own]
                continued = inside
            for line in run.column("value").to_pylist():
                held.append(line)
                inside = inside_after(line.rstrip("\r"), inside, sep)
                if inside:
                    continue
                record = "\n".join(held)
                held = []
                if continued:
                    put("continues", record, False)
                    continued = False
                else:
                    record = record.removesuffix("\r")
                    if record:
                        put("whole", record, heading)
                        heading = False
                if size > FLUSH_BYTES:
                    yield flush()
        close()
        if out:
            yield flush()

    return cut
