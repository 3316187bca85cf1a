import itertools
import random
import re

import pytest

from plumbline.llm import jaccard
from plumbline.llm.components import connected_components
from plumbline.llm.common import Scratch
from plumbline.llm.jaccard import jaccard_components


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, percent=75):
    sets = [shingles(r[1]) if r[0] is not None else set() for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        same = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
            parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(shingles(r[1])), None if r[0] is None else least[find(i)]) for i, r in enumerate(rows)), key=repr)


def answer(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def corpus(seed, groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passages = [[word() for _ in range(60)] for _ in range(3)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.4:
                copy = rng.choice(passages) + copy[: rng.choice([2, 8, 15, 60])]
            if rng.random() < 0.3:
                copy += rng.choice(passages)
            texts.append(rng.choice([" ", "\n", " \t"]).join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_agrees_with_brute_force(make_docs, seed):
    rows = [(10 * i + 3, t) for i, t in enumerate(corpus(seed))]
    assert answer(jaccard_components(make_docs(rows))) == brute(rows)


def test_near_copies_around_one_text_and_hot_passages(make_docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    base, passage = [word() for _ in range(80)], [word() for _ in range(60)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(80)] = word()
        rows.append((1000 - i, " ".join(copy)))
        rows.append((5000 + i, " ".join(passage + [word() for _ in range(i)])))
    rows.append((7000, " ".join(base)))
    assert answer(jaccard_components(make_docs(rows))) == brute(rows)


def test_other_threshold_and_width(make_docs):
    rows = [(i, t) for i, t in enumerate(corpus(9))]
    assert answer(jaccard_components(make_docs(rows), percent=50)) == brute(rows, 50)


def test_edges_of_the_input(make_docs):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One TWO"), (5, "one two"), (5, "one two"), (6, "one"), (None, "one two"), (None, None), (7, long), (8, long + " end"), (9, "Été one"), (10, "été one"), (11, "a b"), (12, "a b")]
    assert answer(jaccard_components(make_docs(rows))) == brute(rows)
    assert answer(jaccard_components(make_docs([]))) == []
    assert answer(jaccard_components(make_docs([(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_same_id_with_different_texts(make_docs):
    rows = [(1, "a b c d e f g h"), (1, "q r s t u v w x"), (2, "a b c d e f g h"), (3, "q r s t u v w x")]
    got = answer(jaccard_components(make_docs(rows)))
    assert got == [(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 4, 1)]


def test_very_long_text_is_hashed_in_pieces(monkeypatch):
    import pyarrow as pa

    from plumbline.llm import shingles as s

    text = " ".join(f"word{i % 977}x{i}" for i in range(5000)) + " " + "y" * 3000
    whole = dict(s.shingle_sets(pa.array([text, "b"])))
    monkeypatch.setattr(s, "LONG_BYTES", 500)
    monkeypatch.setattr(s, "SLICE_BYTES", 100)
    pieces = dict(s.shingle_sets(pa.array([text, "b"])))
    assert all((whole[k] == pieces[k]).all() for k in whole) and len(whole[0]) == 4997


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000), (None, 3)]
    with Scratch(spark) as scratch:
        got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
        none = connected_components(spark.createDataFrame([], "a long, b long"), scratch).collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert none == [] and got == {x: find(x) for x in parent}
