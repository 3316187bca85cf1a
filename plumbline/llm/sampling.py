"""Bounded samples of labelled texts, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import columns, crc_mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, longest: int) -> tuple[list[tuple[str, int]], tuple[float, float]]:
    """``([(text, label)], (rows of class 0, rows of class 1))`` from labelled rows that are not held out.

    Ids are drawn first, from columns without texts, in the order of a hash: at most ``per_class`` of each class. Then one scan
    fetches their texts, one per id (the smallest, of rows that share an id); null texts and texts over ``longest`` bytes are left out.
    Only this bounded sample reaches the driver, however often a labelled id repeats.
    """
    known = columns(labels, doc_id="doc_id", label=label).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_mod(F.col("doc_id"), modulus) != held))
    known = known.select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    there = known.join(columns(docs, doc_id="doc_id"), "doc_id", "left_semi")
    counts = {r["label"]: r["n"] for r in there.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for value in (0, 1):
        own = there.where(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class)
        drawn = own if drawn is None else drawn.unionByName(own)
    picked = [(r["doc_id"], r["label"]) for r in drawn.collect()]
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, label int")
    texts = columns(docs, doc_id="doc_id", text="text").join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= longest)
    once = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = once.select("text", "label", F.xxhash64("doc_id", F.lit(17)).alias("turn"), "doc_id").collect()
    rows.sort(key=lambda r: (r["turn"], r["doc_id"], r["label"], r["text"]))
    return [(r["text"], r["label"]) for r in rows], (float(counts.get(0, 0)), float(counts.get(1, 0)))
