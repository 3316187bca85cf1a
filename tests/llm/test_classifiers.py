import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import compression, hyperdimensional, toxicity
from plumbline.llm.calibration import fit_logistic, sigmoid

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def held(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


def auc(score, label):
    score, label = np.asarray(score), np.asarray(label)
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in score[label == 1] for b in score[label == 0]]))


def scored(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_quality_on_held_out_documents(spark, tables):
    docs, labels = tables
    got = scored(compression.quality(docs, labels))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = [i for i in truth if held(i, 5, 0)]
    assert len(got) == docs.count() and all(got[i]["held_out"] == held(i, 5, 0) and 0 <= got[i]["score"] <= 1 for i in got)
    assert auc([got[i]["score"] for i in out], [truth[i] for i in out]) > 0.95
    good = [got[i]["predicted"] for i in out if truth[i]]
    assert sum(good) >= 0.97 * len(good)


def test_toxicity_on_held_out_documents(spark, tables):
    docs, labels = tables
    got = scored(toxicity.toxicity(docs, labels))
    words = {r["doc_id"]: any(w in r["text"].lower() for w in ("idiot", "moron", "scum", "pathetic", "worthless")) for r in docs.collect()}
    out = [i for i in got if held(i, 4, 2)]
    assert all(got[i]["held_out"] == held(i, 4, 2) and 0 <= got[i]["score"] <= 1 for i in got)
    assert auc([got[i]["score"] for i in out], [int(words[i]) for i in out]) > 0.9


def test_misspellings_share_vectors():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeiourtnsl") for _ in range(rng.randint(2, 8)))
    rows = []
    for k in range(300):
        words = [word() for _ in range(60)]
        if k % 2:
            words[10], words[40] = "blockhead", "Blockheads"
        rows.append((" ".join(words), k % 2))
    model = toxicity.fit_toxicity(rows[:200], rows[200:], (100.0, 100.0))

    def score(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return sigmoid(toxicity.window_scores(model.weight, data, np.array([0, len(data)])) @ model.slopes + model.offset)[0]

    assert score("you blokhead") > 0.5 > score(" ".join(word() for _ in range(60)))


def test_gram_buckets_agree_with_plain_python():
    text = "Ab  cé\nx longest "
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    both = np.concatenate([data, data])
    buckets, words, first, count = toxicity.gram_buckets(both, np.array([0, len(data), 2 * len(data)]))
    names = [f" {w} ".encode() for w in text.lower().split()]
    grams = [(n, k, w[i : i + n]) for n in toxicity.GRAMS for k, w in enumerate(names) for i in range(len(w) - n + 1)]
    assert len(buckets) == 2 * len(grams) and list(count) == [4, 4] and list(first) == [0, 4]
    half = sorted(zip(words[words < 4].tolist(), buckets[words < 4].tolist()))
    assert half == sorted((w - 4, b) for w, b in zip(words[words >= 4].tolist(), buckets[words >= 4].tolist()))
    assert len({g for _, _, g in grams}) >= len(set(buckets.tolist())) >= len({g for _, _, g in grams}) - 1


def test_languages_on_held_out_documents(spark, tables):
    docs, _ = tables
    got = scored(hyperdimensional.languages(docs))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [i for i in got if held(i, 3, 1)]
    assert all(got[i]["held_out"] == held(i, 3, 1) and 0 <= got[i]["score"] <= 1 for i in got)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in out]) > 0.98


def test_bundles_agree_with_plain_sums():
    table = hyperdimensional.letter_table()
    texts = ["Abc, abd", "", "ÉÉ x", "a"]
    bags = [hyperdimensional.gram_counts(t, table) for t in texts]
    found = hyperdimensional.bundle(bags, 256)
    one = {c: hyperdimensional.letter_vectors(np.array([ord(c)]), 256)[0] for c in " abcdéx"}
    for text, row in zip([" abc abd ", None, " éé x ", " a "], found):
        want = np.zeros(256)
        for i in range(len(text or "") - 2):
            a, b, c = text[i : i + 3]
            want += np.roll(one[a], 2) * np.roll(one[b], 1) * one[c]
        assert (row == want).all()


EDGES = [(1, None, "en"), (2, "", "en"), (3, " 12 #!\n", "de"), (4, "x", None), (5, "the same words", "en"), (5, "the same words", "en"), (None, "no id", "en"), (6, "word " * 60_000, "en"), (7, "日本語 текст", "xx")]


@pytest.mark.parametrize("labels", [[(5, 1), (4, 0), (2, 1), (6, 0), (1, 1), (None, 1), (3, None), (99, 1)], [(5, 1)], []])
def test_edges_of_the_input(spark, make_docs, labels):
    table = spark.createDataFrame([(i, y, y, 0) for i, y in labels], "doc_id long, quality int, toxic int, text int")
    docs = make_docs(EDGES)
    for frame in (compression.quality(docs, table), toxicity.toxicity(docs, table)):
        got = frame.collect()
        assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 2, 3, 4, 5, 5, 6, 7]
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] is not None for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
        assert compression.quality(make_docs([]), table).collect() == [] == toxicity.toxicity(make_docs([]), table).collect()


def test_language_edges(make_docs):
    got = hyperdimensional.languages(make_docs(EDGES)).collect()
    names = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(EDGES) and names[1] == names[2] == names[3] == "und" and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert {n for i, n in names.items() if i not in (1, 2, 3)} <= {"en", "de", "xx"} and "und" not in {names[5], names[7], names[None]}
    assert hyperdimensional.languages(make_docs([])).collect() == []
    assert {r["lang_pred"] for r in hyperdimensional.languages(make_docs([(1, "text", None)])).collect()} == {"und"}


def test_long_texts_are_counted_in_parts(monkeypatch):
    table = hyperdimensional.letter_table()
    text = "some words here " * 50
    whole = hyperdimensional.bundle([hyperdimensional.gram_counts(text, table)])
    monkeypatch.setattr(hyperdimensional, "LONG_CHARS", 96)
    parts = hyperdimensional.bundle([hyperdimensional.gram_counts(text, table)])
    assert (whole * parts).sum() / np.linalg.norm(whole) / np.linalg.norm(parts) > 0.98


def test_logistic_curve_recovers_a_known_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 2))
    y = (rng.random(20_000) < sigmoid(2 * x[:, 0] - x[:, 1] + 0.5)).astype(int)
    slopes, offset = fit_logistic(x, y, (float((y == 0).sum()), float(y.sum())))
    assert np.allclose(slopes, [2, -1], atol=0.15) and abs(offset - 0.5) < 0.1


def test_a_labelled_id_with_many_copies_is_one_text(spark, make_docs):
    """Samples hold one text per id, however often it stands in the table."""
    from plumbline.llm.sampling import labelled_sample

    copies = make_docs([(5, "copied text " * 20), (6, "other words " * 20), (7, "third one " * 20)]).limit(3)
    many = copies.join(spark.range(10_000).withColumnRenamed("id", "copy"), F.expr("doc_id = 5 or copy = 0")).drop("copy")
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 1)], "doc_id long, quality int")
    rows, _ = labelled_sample(many, labels, "quality", 5, 9, 100, 1 << 15)
    assert sorted(rows) == sorted([("copied text " * 20, 1), ("other words " * 20, 0), ("third one " * 20, 1)])
    scored = compression.quality(many, labels).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in scored} == {5: 10_000, 6: 1, 7: 1}
