import re

from plumbline.llm.rules import quality_rules, text_measures


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "a a a a a", "x y z\nx y z\n\n \nx y z", "# * $ é|ü <b>\r\n## é\r\n", "a b c d a b c e a b", "日本 語 text 日本 語 text x", "w " * 500, "\n".join(["same line here"] * 9)]


def test_measures_agree_with_plain_python(make_docs):
    frame = text_measures(make_docs([(i, t) for i, t in enumerate(TEXTS)], clash=False))
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in frame.collect()}
    assert got == {i: measures(t) for i, t in enumerate(TEXTS)}


def prose(i, n=80):
    return " ".join(f"word{(i * 7919 + k * k) % 5003}" for k in range(n))


def test_outliers_go_and_the_rest_stays(make_docs):
    rows = [(i, prose(i), "en", f"s{i % 2}") for i in range(80)]
    rows += [(100, prose(100).replace(" ", "### "), "en", "s0"), (101, "\n".join(["line " + prose(3, 6)] * 3 + [prose(5 + k, 6) for k in range(9)]), "en", "s1"), (102, prose(7, 20), "en", "s0"), (103, " ".join(["x" * 40] * 2 + [f"{'y' * 30}{k}" for k in range(70)]), "en", "s1")]
    rows += [(104, prose(8), None, None), (105, None, "en", "s0"), (106, prose(9), "de", "s0"), (None, prose(10), "en", "s0"), (5, prose(5), "en", "s1")]
    got = {}
    for r in quality_rules(make_docs(rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["base_failed"], r["kept"]))
    assert got[100] == [(False, False)] and got[102] == [(True, False)] and got[103] == [(False, False)] and got[105] == [(True, False)]
    assert all(x == [(False, True)] * len(x) for i, x in got.items() if i is None or i < 80 or i in (104, 106)) and len(got[5]) == 2
    assert quality_rules(make_docs([])).collect() == []


def test_groups_fall_back_to_larger_sketches(make_docs):
    rows = [(i, prose(i), "en", "big") for i in range(40)] + [(50 + i, prose(i), "en", "small") for i in range(5)] + [(60, prose(1), "fr", "small")]
    got = {r["doc_id"]: r["group_docs"] for r in quality_rules(make_docs(rows)).collect()}
    assert got[0] == 40 and got[50] == 45 and got[60] == 46


def repetitive(i, n, repeated):
    """``n`` words of which about ``repeated`` stand in repeated windows, on lines of ten."""
    words = [f"word{(i * 7919 + k * k) % 5003}" for k in range(n - repeated)]
    words += [f"again{k % 6}" for k in range(repeated)]
    return "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10))


def test_limits_come_from_the_sketches_of_the_sources(make_docs):
    """Two sources of one language whose texts differ get limits of their own: what is usual in one goes in the other."""
    rows = [(i, repetitive(i, 300, i % 6 * 15), "en", "chatty") for i in range(60)] + [(100 + i, repetitive(i, 300, 0), "en", "terse") for i in range(600)]
    rows += [(1000, repetitive(7, 300, 110), "en", "chatty"), (1001, repetitive(8, 300, 110), "en", "terse"), (1002, repetitive(9, 300, 30), "en", "terse")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules(make_docs(rows)).collect()}
    assert got[1000] == (False, True) and got[1001] == (False, False) and got[1002] == (False, True)
    assert all(kept for i, (_, kept) in got.items() if i < 1000)


def test_long_repetition_goes_and_a_short_repeated_heading_stays(make_docs):
    rows = [(i, prose(i, 60 + i), "en", "s") for i in range(80)]
    heading = "a heading of five words"
    rows += [(200, "\n".join([heading, prose(1, 30), heading, prose(2, 30), heading, prose(3, 9)]), "en", "s")]
    page = [f"menu entry {k} of this site " + prose(k, 12) for k in range(40)]
    rows += [(201, "\n".join([*page, *[prose(100 + k, 30) for k in range(60)], *page[:25]]), "en", "s")]  # a quarter of its lines once more
    rows += [(202, prose(5, 3000), "en", "s")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules(make_docs(rows)).collect()}
    assert got[200] == (False, True) and got[201] == (False, False) and got[202] == (False, True)
    assert all(kept for i, (_, kept) in got.items() if i < 80)
