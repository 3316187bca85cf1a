import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from test_jaccard import brute

import corpus_pipeline as P
from plumbline.llm import compression, hyperdimensional
from plumbline.llm.calibration import sigmoid
from plumbline.llm.mixture import mix_sources

FOLDER = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def plain_near_duplicates(named):
    known = sorted((r for r in named if r["doc_id"] is not None), key=lambda r: (r["doc_id"], r["text"] or ""))
    kept = [r for r in named if r["doc_id"] is None]
    # the place in this order stands for the id, so no two rows share one
    return kept + [known[k] for k, _, least in brute(list(enumerate(r["text"] for r in known))) if k == least]


def plain_stages(spark, docs, folder):
    """The kept rows after each stage, by loops over collected rows; models are learnt by the operators themselves."""
    rows = [r for r in docs.collect()]
    model = compression.learn_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    pair = compression.compressor(model.good), compression.compressor(model.bad)
    good = [r for r in rows if sigmoid(np.array(compression.features((r["text"] or "").encode(), *pair)) @ model.slopes + model.offset) >= P.QUALITY]
    yield good
    profiles, table = hyperdimensional.learn_languages(spark.createDataFrame(good, docs.schema)), hyperdimensional.letter_table()
    named = []
    for r in good:
        (name,), score = hyperdimensional.predict([r["text"]], profiles, table)
        if name != "und" and score[0] >= P.LANGUAGE:
            named.append(r)
    yield named
    kept = plain_near_duplicates(named)
    yield kept
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mix_sources(spark.createDataFrame(kept, docs.schema)).collect()}
    mixed = []
    for r in kept:
        words, size = taken[r["doc_id"]]
        if size:
            mixed += [r] * (words // size + (2 * (words % size) >= size))
    yield mixed
    library = sentencepiece.SentencePieceProcessor(model_file=P.PIECE_MODEL)
    yield [(r["doc_id"], ids, r["lang"], r["source"], len(ids)) for r in mixed for ids in [library.encode(r["text"])]]


def check(spark, docs, folder):
    for (name, stage), want in zip(P.STAGES, plain_stages(spark, docs, folder), strict=True):
        out = stage(spark, docs, folder)
        got = rows_of(out)
        assert got == sorted((tuple(r) for r in want), key=repr), name
        if name != "encoding":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(got, docs.schema)
    return got


def test_stages_agree_with_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = check(spark, docs, FOLDER)
    assert len(got) > 50
    assert Counter(r[:1] for r in rows_of(P.run(spark, FOLDER))) == Counter(r[:1] for r in got)


def test_edges_of_the_input(spark, tmp_path, make_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = docs.where("doc_id < 40").collect()
    extra = [(900, None, "en", "src1", 0), (901, "", "en", "src1", 0), (902, "12 34 !!", None, None, 0), (some[1]["doc_id"], some[1]["text"], some[1]["lang"], some[1]["source"], some[1]["n_chars"]), (None, some[4]["text"], "fr", None, 1), (903, some[4]["text"] + " x", None, None, None), (904, "long words here " * 20_000, "en", "src2", 1)]
    mixed = spark.createDataFrame([tuple(r) for r in some] + extra, docs.schema)
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    check(spark, mixed, str(tmp_path))
    # ids that repeat with other texts: near copies of others, copies of each other, and texts found nowhere else
    ids = [some[k]["doc_id"] for k in (2, 3, 5)]
    other = [(i, text, "en", "src1", 0) for i, text in zip(ids, (some[7]["text"], "a text of its own about " + some[8]["text"][:400], some[9]["text"]))]
    other += [(ids[0], other[1][1], "en", "src1", 0), (ids[1], other[1][1], "en", "src1", 0)]
    shared = spark.createDataFrame([tuple(r) for r in some] + other, docs.schema)
    kept = P.near_duplicates(spark, shared, str(tmp_path)).collect()
    rows = list(plain_near_duplicates(shared.collect()))
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted((r["doc_id"], r["text"]) for r in rows)
    assert {r["text"] for r in kept} >= {other[1][1]}
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_pass_through(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60")
    more = docs.selectExpr("*", "doc_id as size", "lang as component_id", "1 as taken", "2 as score", "3 as lang_pred", "4 as _x")
    for name, stage in P.STAGES[:-1]:
        plain, wide = stage(spark, docs, FOLDER), stage(spark, more, FOLDER)
        assert wide.columns == more.columns and rows_of(wide.select(*docs.columns)) == rows_of(plain), name
    assert "size" not in P.STAGES[-1][1](spark, more, FOLDER).columns


def test_pipeline_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(re.match(rf"op{n}_", q) for q in names) for n in range(1, 11))
    assert 4 <= len(P.STAGES) <= 5


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_empty_tables(spark, stage):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    assert stage(spark, docs, FOLDER).collect() == []
