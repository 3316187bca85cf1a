import random

import corpus_pipeline as P

SYLLABLES = {"en": "the and ing er th on re ted all wh of is ly nd".split(), "fr": "les ou eux que tion oi ai é è la de ch une ê".split(), "fi": "kk ää yt iin ssa tt uo hy vä mme pp lla äk jo".split()}


def text(lang, seed, words=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words)).capitalize() + "."


def test_texts_far_from_all_languages_go(spark, make_docs):
    rng = random.Random(1)
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n)) for n in (200, 2000)]
    clean = [(i, text(lang, i, 5 + 7 * (i % 40)), lang) for i in range(240) for lang in [("en", "fr")[i % 2]]]
    clean += [(500, text("en", 500), None), (501, text("fr", 501, 3), None), (502, (text("en", 502, 4) + " ") * 200, None), (503, text("en", 503, 40).upper().replace(" ", "!! "), None), (504, "12.5 " + text("fr", 504).replace(" ", ", "), None)]
    far = [(600 + k, t, None) for k, t in enumerate([*letters, text("fi", 1), text("fi", 2, 400), "a" + " ### $$$ ***" * 30, "", "12 !!"])]
    got = {r["doc_id"] for r in P.language_filter(spark, make_docs(clean + far), "").collect()}
    assert not got & {i for i, *_ in far}
    lost = {i for i, *_ in clean} - got
    assert len(lost) <= 2 and not lost & {500, 501, 502, 503, 504}


def test_languages_of_few_texts_lose_nothing(spark, make_docs):
    rows = [(i, text(lang, i), lang) for i in range(5) for lang in ["en"]] + [(9, text("fi", 9), None)]
    assert P.language_filter(spark, make_docs(rows), "").count() == 6
