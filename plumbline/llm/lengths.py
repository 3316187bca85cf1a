"""Exact token-length histogram: one row per encoded length, with suffix sums that answer any context limit.

Documents are encoded once and only their lengths go on. The histogram is summed before it is shuffled, so its size follows the number
of different lengths. Suffix sums are taken inside ranges of lengths and over the totals of the ranges, never in one task.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import Scratch, columns, freed

# fixed value: the published word pattern of this vocabulary family
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = 10_000  # blanks in a row from which the pattern's look-ahead is replaced by the same cut made here
RANGE = 1024  # lengths that share a task in the suffix sums


class TokenCounter:
    """Numbers of tokens under a byte-level BPE given as a file of ranks; strings of special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding("plumbline", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.blanks = re.compile(r"\s{%d,}" % LONG_RUN)

    def count(self, text: str) -> int:
        runs = list(self.blanks.finditer(text)) if len(text) >= LONG_RUN else []
        total = at = 0
        for run in runs:
            # a run is one piece, but for its last blank when something follows
            end = run.end() - (run.end() < len(text))
            total += self._encoded(text[at : run.start()]) + len(self.encoding._encode_single_piece(text[run.start() : end]))
            at = end
        return total + self._encoded(text[at:])

    def _encoded(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0


def token_lengths(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n_tokens, *keep)``: one row per row of ``docs``; null and empty texts have length 0. ``ranks`` is a path every executor can read."""
    given = columns(docs, doc_id=doc_id, text=text, **{k: k for k in keep})
    schema = T.StructType([given.schema["doc_id"], T.StructField("n_tokens", T.LongType()), *[given.schema[k] for k in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or TokenCounter(ranks)
            counts = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *batch.columns[2:]], names=schema.names)

    return given.mapInArrow(freed(run), schema)


def length_histogram(lengths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n_tokens, n_docs)``; nulls in ``by`` are a group."""
    return lengths.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The histogram with, per row of length ``L``: ``docs_from, tokens_from`` (documents of at least ``L`` tokens and their tokens),
    ``tokens_within`` (what is left of all documents cut at ``L``), ``docs_all, tokens_all`` and ``rank`` (share of documents up to ``L``)."""
    with Scratch(histogram.sparkSession) as scratch:
        # two uses of one small table; unkept, each would encode every text
        histogram = scratch.keep(histogram, release=True)
    parts = histogram.withColumn("_range", F.floor(F.col("n_tokens") / RANGE))
    sums = parts.groupBy(*by, "_range").agg(F.sum("n_docs").alias("_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_tokens"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    above = group.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = {"docs_all": F.sum("_docs").over(group), "tokens_all": F.sum("_tokens").over(group)}
    sums = sums.withColumns({**whole, "_docs_above": F.coalesce(F.sum("_docs").over(above), F.lit(0)), "_tokens_above": F.coalesce(F.sum("_tokens").over(above), F.lit(0))})
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), "docs_all", "tokens_all", "_docs_above", "_tokens_above")
    on = F.col("_range") == F.col("_at")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    own = Window.partitionBy(*by, "_range").orderBy(F.col("n_tokens").desc())
    out = parts.join(sums, on)
    out = out.withColumn("docs_from", F.sum("n_docs").over(own) + F.col("_docs_above"))
    out = out.withColumn("tokens_from", F.sum(F.col("n_docs") * F.col("n_tokens")).over(own) + F.col("_tokens_above"))
    within = F.col("tokens_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")
    rank = (F.col("docs_all") - F.col("docs_from") + F.col("n_docs")) / F.col("docs_all")
    return out.select(*by, "n_tokens", "n_docs", "docs_from", "tokens_from", within.alias("tokens_within"), "docs_all", "tokens_all", rank.alias("rank"))


def at_limits(sums: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, limit, docs_over, tokens_within)`` for each context limit, from the suffix sums alone.

    The smallest length above the limit says how many documents are cut and how many tokens they have.
    """
    table = sums.withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    over = F.when(F.col("n_tokens") > F.col("limit"), F.struct("n_tokens", "docs_from", "tokens_from"))
    found = table.groupBy(*by, "limit").agg(F.min(over).alias("over"), F.max("tokens_all").alias("all"))
    cut = F.coalesce(F.col("over.docs_from"), F.lit(0))
    return found.select(*by, "limit", cut.alias("docs_over"), (F.col("all") - F.coalesce(F.col("over.tokens_from"), F.lit(0)) + cut * F.col("limit")).alias("tokens_within"))


def quantiles(sums: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, share, n_tokens)``: the smallest length that at least ``share`` of the documents do not exceed."""
    table = sums.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    return table.where(F.col("rank") >= F.col("share")).groupBy(*by, "share").agg(F.min("n_tokens").alias("n_tokens"))
