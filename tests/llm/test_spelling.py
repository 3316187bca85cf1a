"""Spelling variants against plain loops over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import spelling
from plumbline.llm.spelling import spelling_variants
from plumbline.session import BROADCAST_BYTES_CONF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs, length=6, count=5, ratio=5, slip=199):
    n = Counter()
    for i, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            code = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and code % slip == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def run(frame, **more):
    found = spelling_variants(frame, **more)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 9))) for _ in range(25)]
    words = []
    for k, s in enumerate(stems):
        words += [s] * (400 >> (k % 6))
        at = rng.randrange(len(s))
        words += [s[:at] + "z" + s[at:]] * 12 + [s[:at] + s[at + 1 :]] * 7 + [s[:at] + "ÿ" + s[at + 1 :]] * 5
    words += ["Aaaaaa", "aaaaaaa", "AAAAAAAA"] * 30 + ["×÷ÀÉÿß"] * 40 + ["xÀÉÿßß"] * 6 + ["chained"] * 700 + ["chainet"] * 130 + ["chainot"] * 25 + ["chaixot"] * 5
    rng.shuffle(words)
    out = [(k, " ".join(words[k::40]) + ".", None, None) for k in range(40)]
    out += out[:3] + [(None, "Stems Aaaaaa; aaaaaaa-aaaaaaa_chained 中文 chainet’s", None, None), (90, None), (91, ""), (92, "  \n"), (93, "long" * 5000 + " " + "y" * 3000)] + [(94, "y" * 3001)] * 5 + [(95, "y" * 3000)] * 30
    return out


def test_against_plain_loops(spark, make_docs, docs):
    for slip in (199, 2):
        assert run(make_docs(docs), slip=slip) == plain(docs, slip=slip)
    found = {r[0]: r[2] for r in run(make_docs(docs), slip=0)}
    assert found["chaixot"] == "chained" and found["y" * 3001] == "y" * 3000


def test_small_rounds_pieces_and_counts(spark, make_docs, docs, monkeypatch):
    """Filters in many rounds and cuts, texts in pieces, edits in small groups: the same result."""
    monkeypatch.setattr(spelling, "PIECE", 64)
    monkeypatch.setattr(spelling, "HELD", 5)
    monkeypatch.setattr(spelling, "PROBES", 100)
    short = [d for d in docs if d[1] is None or len(d[1]) < 3000]
    spark.conf.set(BROADCAST_BYTES_CONF, "16")
    try:
        assert run(make_docs(short), least_length=4, least_count=3, ratio=2) == plain(short, 4, 3, 2)
    finally:
        spark.conf.unset(BROADCAST_BYTES_CONF)


def test_no_words(spark, make_docs):
    assert run(make_docs([])) == []
    assert run(make_docs([(1, None), (2, ""), (None, "a b c")])) == []


def test_edit_hashes_are_those_of_the_edited_words():
    words = ["aabbcé", "zzzzzz", "abcdef"]
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(3, 6)
    key = letters.astype(np.uint64) @ spelling._powers(6)
    alphabet = [97, 98, 122, 233]
    got = Counter()
    for size, rows, hashes in spelling.edit_hashes(letters, key, np.array(alphabet, np.uint8)):
        got.update((size, int(r), int(h)) for r, h in zip(rows, hashes))

    def hashed(text):
        return sum(ord(c) * pow(spelling.BASE, k, 1 << 64) for k, c in enumerate(text)) % (1 << 64)

    want = Counter()
    for r, w in enumerate(words):
        want.update({(5, r, hashed(w[:k] + w[k + 1 :])) for k in range(6)})
        want.update((6, r, hashed(w[:k] + chr(c) + w[k + 1 :])) for k in range(6) for c in alphabet if c > ord(w[k]))
    assert got == want
