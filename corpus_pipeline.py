"""A corpus pipeline: quality, language, near duplicates, mixture, encoding.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept and, but for the last, returns the columns of
``docs``. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, small_side
from plumbline.llm.compression import learn_quality, quality_score
from plumbline.llm.encoding import encode
from plumbline.llm.hyperdimensional import NONE, language_of, learn_languages
from plumbline.llm.jaccard import jaccard_components
from plumbline.llm.mixture import mix_sources
from plumbline.llm.queries import PIECE_MODEL

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

QUALITY = 0.3  # least probability of good quality
LANGUAGE = 0.5  # least score: below, the text is farther from its language than nearly all texts of that language


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good stay; null and empty texts get its score without evidence."""
    model = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_score(model)("text") >= QUALITY)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt stay; those without a letter, or far from all languages, go."""
    found = language_of(learn_languages(docs))("text")
    return docs.where((found["lang_pred"] != NONE) & (found["score"] >= LANGUAGE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest id, of rows that share it one of them.

    Rows that share an id but not a text are documents of their own, and none goes for the other's sake. Rows without an id stay, as
    do null and blank texts.
    """
    row = next(name for k in range(len(docs.columns) + 1) if (name := f"_row{k}") not in docs.columns)
    ids = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    with Scratch(spark) as scratch:
        ids = scratch.keep(ids, release=True)
        repeated = ids.count()
        given = docs.withColumn(row, F.lit(0).cast("long"))
        if repeated:
            # the rows of these ids are written with a key of their own, no others
            side = small_side(ids, repeated, 16)
            again = docs.join(side, "doc_id", "left_semi").select(*docs.columns).withColumn(row, F.monotonically_increasing_id())
            given = docs.join(side, "doc_id", "left_anti").select(*docs.columns).withColumn(row, F.lit(0).cast("long")).unionByName(scratch.keep(again, release=True))
        gone = jaccard_components(given, row=row).where("not kept").select("doc_id", F.col("row").alias(row))
        gone = scratch.keep(gone, release=True)
    return given.join(small_side(gone, gone.count(), 24), ["doc_id", row], "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once per full pass, and once more if it takes at least half of the words again.

    Documents without words go. Rows that share an id, or have none, share the largest number.
    """
    taken = mix_sources(docs).where("size > 0")
    copies = F.floor(F.col("taken") / F.col("size")) + (2 * (F.col("taken") % F.col("size")) >= F.col("size")).cast("int")
    times = taken.groupBy("doc_id").agg(F.max(copies).cast("int").alias("_copies")).where("_copies > 0").withColumnRenamed("doc_id", "_id")
    with Scratch(spark) as scratch:
        times = scratch.keep(times, release=True)
    wordy = docs.where(F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)))
    joined = wordy.join(small_side(times, times.count(), 24), docs["doc_id"].eqNullSafe(times["_id"]))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, lang, source, n_tokens)`` of every row of the mixture."""
    return encode(docs, PIECE_MODEL, keep=["lang", "source"]).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_filter", quality_filter),
    ("language_filter", language_filter),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("encoding", encoding),
]
ORACLE_SQL = None  # compressed sizes, random vectors and BPE are beyond SQL; tests/llm/test_pipeline.py has a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES):
            docs = scratch.keep(stage(spark, docs, sf_dir), release=k == len(STAGES) - 1)
    return docs
