"""Helpers of the operators: column selection by exact name, owned scratch tables, hash samples."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable
from types import TracebackType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.common import q
from plumbline.session import broadcast_bytes, scratch_dir

# a word: a run of characters other than space and 0x09-0x0D
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns of ``df`` cannot clash with them."""
    return df.select(*[q(c).alias(name) for name, c in named.items()])


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows fit the session's bound; else Spark joins by shuffling."""
    return F.broadcast(df) if rows * row_bytes <= broadcast_bytes(df.sparkSession) else df


def freed(run: Callable) -> Callable:
    """``run``, a function over an iterator of batches, that gives unused memory back at its end: workers live on for other stages."""

    @functools.wraps(run)
    def until_the_end(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
            if trim is not None:
                trim(0)

    return until_the_end


class Scratch:
    """Written intermediate tables in the folder all executors share; those not passed to :meth:`release` go at the end.

    A written table survives lost executors and cuts the lineage.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{scratch_dir(spark).rstrip('/')}/plumbline-llm-{uuid.uuid4().hex}"
        self._tables: dict[str, bool] = {}

    def keep(self, df: DataFrame, release: bool = False) -> DataFrame:
        """Write ``df`` and read it back; ``release`` keeps the files for a result that is read later."""
        path = f"{self.folder}/{len(self._tables)}"
        df.write.parquet(path)
        self._tables[path] = release
        return self.spark.read.schema(df.schema).parquet(path)

    def room(self) -> str:
        """A folder that the caller fills; it goes at the end."""
        path = f"{self.folder}/{len(self._tables)}"
        self._tables[path] = False
        return path

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path, release in self._tables.items():
            if not release:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
