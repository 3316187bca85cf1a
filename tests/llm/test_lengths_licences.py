import base64
import re

import public_tokenizers
import pytest
import regex
import tiktoken

from plumbline.llm import lengths
from plumbline.llm.lengths import TokenCounter, at_limits, length_histogram, quantiles, suffix_sums, token_lengths
from plumbline.llm.licences import NOTICES, known_licences, scan_licences

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_long_runs_of_blanks(monkeypatch):
    monkeypatch.setattr(lengths, "LONG_RUN", 5)
    counter, other = TokenCounter(RANKS), library()
    for text in ["a" + " " * 9 + "b", " " * 30, "x" + "\n" * 7, " " * 6 + "12", "a  b" + "\t" * 8 + "." + " " * 5 + "c ", "é" + " \n" * 6 + "<|endoftext|>", "a" + " " * 8 + "b"]:
        assert counter.count(text) == len(other.encode_ordinary(text))
    monkeypatch.setattr(lengths, "LONG_RUN", 10_000)
    assert TokenCounter(RANKS).count("a" + " " * 1_200_000 + "b") > 2


def test_histogram_answers_every_limit(make_docs, spark):
    texts = [None, "", "a", "one two", "one two three " * 9, "x " * 3000, "é" * 50] * 3 + [f"word {k} " * (k % 37) for k in range(150)]
    rows = [(k, t, ["en", None, "de"][k % 3]) for k, t in enumerate(texts)] + [(None, "no id", "en")]
    other = library()
    size = [(r[2], len(other.encode_ordinary(r[1] or ""))) for r in rows]
    frame = token_lengths(make_docs(rows, clash=False), RANKS, keep=["lang"])
    assert sorted((r["lang"] or "", r["n_tokens"]) for r in frame.collect()) == sorted((lang or "", n) for lang, n in size)
    for by in (["lang"], []):
        sums = suffix_sums(length_histogram(frame, by), by)
        for r in sums.collect():
            own = [n for lang, n in size if not by or lang == r["lang"]]
            cut = r["n_tokens"]
            want = (own.count(cut), sum(n >= cut for n in own), sum(n for n in own if n >= cut), sum(min(n, cut) for n in own), len(own), sum(own), sum(n <= cut for n in own) / len(own))
            assert tuple(r)[-7:] == pytest.approx(want)
        limits = [0, 1, 5, 100, 2048, 10**6]
        got = {(r["lang"] if by else None, r["limit"]): (r["docs_over"], r["tokens_within"]) for r in at_limits(sums, limits, by).collect()}
        for (lang, limit), value in got.items():
            own = [n for x, n in size if not by or x == lang]
            assert value == (sum(n > limit for n in own), sum(min(n, limit) for n in own))
        assert len(got) == len(limits) * (3 if by else 1)
        for r in quantiles(sums, [0.0, 0.5, 0.9, 1.0], by).collect():
            own = sorted(n for x, n in size if not by or x == r["lang"])
            assert r["n_tokens"] == next(n for n in own if sum(m <= n for m in own) >= r["share"] * len(own))
    assert suffix_sums(length_histogram(token_lengths(make_docs([]), RANKS))).collect() == []


def test_public_pattern_is_the_one_given():
    assert lengths.PATTERN == public_tokenizers.PATTERN and regex.compile(lengths.PATTERN)


def test_variants_of_a_licence_have_one_digest(spark, make_docs):
    mit = next(t for n, t in NOTICES if n == "MIT" and "Permission" in t)
    isc = next(t for n, t in NOTICES if n == "ISC")
    loud = "Copyright (c) 2021 Some One\n\n" + re.sub(r"\s+", "\n  ", mit).upper().replace("SUBLICENSE", "SUBLICENCE").replace('"', "“") + "\nAll rights reserved.\n"
    rows = [(1, mit), (2, loud), (3, isc), (4, mit + " and more"), (5, None), (6, ""), (7, "!?"), (8, "© 2020 X"), (9, "prose\nReleased under the  MIT licence!\n\nLicensed under CC BY-NC 4.0.\nmore"), (1, mit), (None, isc), (10, "word " * 100_000)]
    got = {}
    for r in scan_licences(make_docs(rows), known_licences(spark)).collect():
        got.setdefault(r["doc_id"], []).append((r["licence"], r["digest"] is None, r["n_notices"], r["notices"]))
    assert len(got[1]) == 2 and got[1][0][0] == got[2][0][0] == "MIT" and got[3][0][0] == got[None][0][0] == "ISC"
    assert got[4][0][0] is None and all(got[i] == [(None, True, 0, [])] for i in (5, 6, 7, 8))
    assert got[9] == [(None, False, 2, ["CC-BY-NC-4.0", "MIT"])] and got[10] == [(None, False, 0, [])]
    nothing = spark.createDataFrame([], "digest string, licence string")
    assert [r["licence"] for r in scan_licences(make_docs(rows[:1]), nothing).collect()] == [None]
    assert scan_licences(make_docs([]), nothing).collect() == []


def test_large_tables_are_joined_without_broadcast(spark, make_docs, distributed):
    rows = [(1, "Released under the MIT License."), (2, "x\nReleased under the MIT License.")]
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in scan_licences(make_docs(rows), known_licences(spark)).collect()}
    assert got == {1: ("MIT", ["MIT"]), 2: (None, ["MIT"])}
