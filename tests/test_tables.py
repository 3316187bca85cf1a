import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import clean, convlog, diff, merge
from plumbline.sources import files


@pytest.fixture(scope="module")
def versions(spark):
    schema = "id long, a double, b string, c long, d string, e string, f string"
    before = [(1, 1.0, "x", 1, "p", "q", "r"), (2, None, "y", 2, "p", "q", "r"), (3, 3.0, "z", 3, "p", "q", "s"), (4, 4.0, None, 4, "p", "t", "r")]
    after = [(1, 1.0, "x", 1, "p", "q", "r"), (2, 2.0, "y", 2, "p", "q", "r"), (3, 3.0, "zz", 3, "p", "q", "s"), (5, 5.0, None, 9, "k", "l", "m")]
    return spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)


def test_diff_with_itself_is_empty(versions):
    before, _ = versions
    assert diff.row_changes(before, before, ["id"]).count() == 0
    assert diff.keyless_diff(before, before).count() == 0


def test_keyed_diff(versions):
    before, after = versions
    assert {(r["id"], r["change"]) for r in diff.row_changes(before, after, ["id"]).collect()} == {
        (2, "modified"), (3, "modified"), (4, "removed"), (5, "added")
    }
    cells = {(r["id"], r["column"]): r["text"] for r in diff.cell_changes(before, after, ["id"]).collect()}
    assert cells == {(2, "a"): "None → 2.0", (3, "b"): "z → zz"}
    assert {r["id"]: r["filled"] for r in diff.imputed_rows(before, after, ["id"]).collect()} == {1: 0, 2: 1}


def test_keyless_diff_matches_keyed(versions):
    before, after = versions
    found = [(r["change"], r["row"]["id"], r["column"]) for r in diff.keyless_diff(before, after).collect()]
    assert sorted(found, key=str) == sorted(
        [("removed", 4, None), ("added", 5, None), ("modified", 2, "a"), ("modified", 3, "b")], key=str
    )


def test_similarity_allows_few_changes():
    assert [diff.allowed_changes(n, 0.8) for n in (3, 5, 6, 10, 11)] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("width", [25, 60])
def test_wide_keyless_diff_agrees_with_brute_force(spark, width):
    rng = np.random.default_rng(width)
    names, most = [f"c{i}" for i in range(width)], diff.allowed_changes(width, diff.SIMILARITY)
    before = [[int(x) if x else None for x in rng.integers(0, 40, width)] for _ in range(30)]
    after = []
    for row in before[:24]:
        edited = list(row)
        for k in rng.choice(width, rng.integers(0, most + 3), replace=False):
            edited[k] = rng.choice([None, 77, 78])
        after.append([None if x is None else int(x) for x in edited])
    schema = ", ".join(f"{c} int" for c in names)
    got = {tuple(r["a"]): (r["different"], tuple(r["b"])) for r in diff.similar_rows(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).collect()}
    want = {}
    for a in after:
        n, b = min((sum(x != y for x, y in zip(a, b)), tuple(-1 if v is None else v for v in b), tuple(b)) for b in before)[::2]
        if n <= most:
            want[tuple(a)] = (n, b)
    assert got == want and 10 < len(want) < 24


def test_hot_look_alikes_stay_small(spark):
    """All rows share five of six cells: pairs per key would be quadratic, representatives are not."""
    before = spark.range(3000).select(*[F.lit(i).alias(f"c{i}") for i in range(5)], F.col("id").alias("x"))
    after = before.withColumn("x", F.col("x") + 1500)
    pairs = diff.similar_rows(before, after)
    assert pairs.count() == 3000
    assert pairs.where("different = 0").count() == 1500


def test_sentinels_and_nan(spark):
    table = spark.createDataFrame([(1.0, "n/a"), (float("nan"), "ok"), (-9.0, "ok")], "x double, s string")
    rows = clean.sentinels_to_null(table, {"x": [-9.0], "s": ["n/a"]}).collect()
    assert [tuple(r) for r in rows] == [(1.0, None), (None, "ok"), (None, "ok")]


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d,e\n1,1.5,True,x,\n2,NA,False,n/a,\n3,2,True,y,\n")
    table = files.read_csv(spark, str(path))
    assert dict(table.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "double"}
    assert [r["b"] for r in table.orderBy("a").collect()] == [1.5, None, 2.0]
    assert [r["d"] for r in table.orderBy("a").collect()] == ["x", None, "y"]


def test_separator_retry_and_failure(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n1;2\n3;4\n")
    table, sep = files.read_any_separator(spark, str(tmp_path / "t.csv"))
    assert sep == ";" and table.count() == 2
    (tmp_path / "u.csv").write_text("a\n1\n2\n")
    with pytest.raises(ValueError):
        files.read_any_separator(spark, str(tmp_path / "u.csv"))


def test_stage_never_overwrites(spark, tmp_path):
    table = spark.range(3)
    path = str(tmp_path / "data.parquet")
    assert files.save_stage(table, path, "merged").endswith("data_merged.parquet")
    with pytest.raises(Exception, match="(?i)exists"):
        files.save_stage(table, path, "merged")


def test_file_listing(spark, tmp_path):
    (tmp_path / "model_best.pkl").write_bytes(b"0" * 2048)
    (tmp_path / "other.pkl").write_bytes(b"0")
    (tmp_path / "plot.PNG").write_bytes(b"0")
    (tmp_path / "data.csv").write_text("a,b\n")
    (tmp_path / "script.py").write_text("pass")
    found = {r["name"]: r for r in files.list_files(spark, str(tmp_path)).collect()}
    assert {n: r["category"] for n, r in found.items()} == {
        "model_best.pkl": "model", "other.pkl": "other", "plot.PNG": "image", "data.csv": "data"
    }
    assert (found["model_best.pkl"]["size"], found["model_best.pkl"]["unit"]) == (2.0, "KB")
    assert files.newest_files(files.list_files(spark, str(tmp_path)), ["data"]).count() == 1


def test_duration_units(spark):
    one = spark.createDataFrame([(datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 15, 12))], "a timestamp_ntz, b timestamp_ntz")
    row = one.select(*[clean.duration(F.col("a"), F.col("b"), u).alias(u) for u in ("DAY", "WEEK", "MONTH", "HOUR")]).first()
    assert tuple(row) == (45, 6, 1, 1092)
    with pytest.raises(ValueError):
        clean.duration(F.col("a"), F.col("b"), "FORTNIGHT")


def test_column_matches_rank_the_true_pair_first(spark):
    left = spark.createDataFrame([(i, i * 2) for i in range(50)], "patient_id long, dose long")
    right = spark.createDataFrame([(i, i + 1000) for i in range(10, 60)], "PatientID long, weight long")
    best = merge.match_columns(left, right).orderBy(F.desc("score")).first()
    assert (best["left_column"], best["right_column"]) == ("patient_id", "PatientID")
    assert best["name_score"] == 1.0 and best["overlap"] == pytest.approx(40 / 60)


def test_names_and_sizes(spark):
    one = spark.createDataFrame([("a b/c#é.txt", 1536.0)], "s string, n double")
    row = one.select(scalars.safe_name(F.col("s"), True).alias("s"), scalars.human_size(F.col("n")).alias("n")).first()
    assert row["s"] == "a-bc-é.txt" and tuple(row["n"]) == (1.5, "KB")
    with pytest.raises(Exception, match="path separator"):
        one.select(scalars.safe_name(F.col("s"))).collect()


def test_blocks_report_the_first_problem(spark):
    good = "DEPENDENCIES:\n```\npip install a-b\n```\nCODE:\n```python\nx = 1\n```\nFILES_IN:\n```\na.csv\n```\nFILES_OUT:\n```\n```"
    texts = [good, good.replace("CODE:", "NOTHING:"), good.replace("a-b", "a b"), good.replace("x = 1", " "), good.replace("a-b", "None")]
    rows = [r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.fenced_blocks(F.col("t")).alias("f")).collect()]
    assert rows[0]["error"] is None and rows[0]["dependencies"] == ["a-b"] and rows[0]["code"] == "x = 1" and rows[0]["files_out"] == []
    assert [r["error"] for r in rows[1:4]] == ["no CODE block", "bad dependency name: a b", "code block is empty"]


def test_plan_progress_cases(spark):
    plans = spark.createDataFrame([(["a", "b", "c"], "b"), (["a", "b"], "None"), (["a"], "z")], "plan array<string>, current string")
    rows = [(r["completed"], r["remaining"]) for r in convlog.plan_progress(plans).collect()]
    assert rows == [(["a", "b"], ["c"]), ([], ["a", "b"]), (["a", "z"], [])]
    shorter = convlog.plan_progress(plans, include_current=False).first()
    assert (shorter["completed"], shorter["remaining"]) == (["a"], ["c"])


def test_long_transcripts_continue_in_parts(spark):
    talk = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(5)], "conv_id long, turn long, role string, text string")
    assert [(r["part"], r["transcript"].count("**User:**")) for r in convlog.transcript(talk).collect()] == [(0, 5)]
    parts = convlog.transcript(talk, turns_per_part=2).orderBy("part").collect()
    assert [p["part"] for p in parts] == [0, 1, 2]
    assert parts[2]["transcript"] == "**User:**\n\nm4\n"


def test_running_keeps_null_groups_on_both_paths(spark, request):
    from plumbline.operators.ranks import running

    table = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5)], "g string, t int, n int")
    rows = lambda: sorted((tuple(r) for r in running(table, ["g"], ["t"], ["n"]).select("g", "t", "cum_n", "next_t").collect()), key=repr)
    near = rows()
    request.getfixturevalue("distributed")
    assert near == rows() == sorted([(None, 1, 2, 2), (None, 2, 5, None), ("a", 1, 5, None)], key=repr)


def test_moments_do_not_depend_on_the_first_rows(spark):
    from plumbline.operators import profile

    table = spark.range(50_000).select(F.when(F.col("id") >= 1000, F.lit(1.7e9) + F.col("id") % 10).alias("x"))
    found = profile.moments(table).first()
    assert found["std"] == pytest.approx(2.8723, abs=1e-3) and found["skew"] == pytest.approx(0, abs=1e-3) and found["kurt"] == pytest.approx(-1.2242, abs=1e-3)


def test_codes_are_not_numbers(spark):
    from plumbline.operators import clean

    table = spark.createDataFrame([("10D", "1.5", "1e3"), ("12F", ".5", "-2.")], "ward string, x string, y string")
    assert {r["column"]: r["suggested"] for r in clean.type_suggestions(table).collect()} == {"ward": "string", "x": "double", "y": "double"}


def test_quoted_line_breaks_stay_in_their_cell(spark, tmp_path):
    (tmp_path / "notes.csv").write_text('id,note\n1,"two\nlines, ""quoted"""\n2,plain\n')
    rows = files.read_csv(spark, str(tmp_path / "notes.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'two\nlines, "quoted"'), (2, "plain")]
    assert files.read_any_separator(spark, str(tmp_path / "notes.csv"))[1] == ","


def test_keyed_diff_with_null_and_repeated_keys(spark):
    table = spark.createDataFrame([(None, 1, "a"), (1, None, "b"), (1, None, "c"), (2, 2, "d")], "k int, k2 int, v string")
    for found in (diff.row_changes(table, table, ["k", "k2"]), diff.cell_changes(table, table, ["k", "k2"])):
        assert found.count() == 0
    edited = table.withColumn("v", F.when(F.col("k").isNull(), "z").otherwise(F.col("v"))).where("v <> 'd'")
    got = sorted((r["k"], r["k2"], r["change"]) for r in diff.row_changes(table, edited, ["k", "k2"]).collect() if r["k"] is not None)
    assert got == [(2, 2, "removed")] and diff.cell_changes(table, edited, ["k", "k2"]).collect()[0]["after"] == "z"


def test_unseen_classes_count_as_wrong(spark):
    from plumbline.operators import models

    train = spark.createDataFrame([(float(i % 2), "ab"[i % 2]) for i in range(40)], "x double, y string")
    test = spark.createDataFrame([(0.0, "a"), (1.0, "b"), (0.0, "new"), (1.0, "new")], "x double, y string")
    study = models.classification_study(train, test, "y", folds=0, candidates=("linear_model",))
    assert {r["metric"]: r["value"] for r in study.scores.collect()}["accuracy"] == 0.5


def test_wide_texts_stay_in_the_features(spark):
    from plumbline.operators import models

    table = spark.range(600).select("id", F.concat(F.lit("ward "), F.col("id").cast("string")).alias("ward"), (F.col("id") % 3).cast("string").alias("kind"), F.rand(1).alias("x"))
    fitted = models.fit_features(table, ["id"])
    assert models.feature_names(fitted) == ["x", "ward", "kind"]
    assert models.prepared(fitted, table).count() == 600


def test_many_classes_are_balanced(spark):
    from plumbline.operators import balance

    table = spark.range(3600).select("id", F.when(F.col("id") < 2400, F.col("id") % 1200).otherwise(F.lit(7)).alias("y"))
    assert {r["count"] for r in balance.undersample(table, "y", "id").groupBy("y").count().collect()} == {2}
    assert {r["count"] for r in balance.oversample(table.where("y < 50 or id > 2500"), "y", "id", size=5).groupBy("y").count().collect()} == {5, 1202}


def test_leakage_by_sketches_equals_all_values(spark):
    """A contradiction outside of the sketch still clears its column; fixed columns stay whatever their size."""
    rows = [(i // 8 % 5, f"k{i // 2}", f"k{i // 2}" if i < 19_999 else "k0", i // 4, None, i % 7) for i in range(20_000)]
    table = spark.createDataFrame(rows, "y int, half string, nearly string, four int, gap string, seven int")
    found = {tuple(r) for r in clean.leakage_candidates(table, "y").collect()}
    pdf = table.toPandas()
    want = set()
    for c in ("half", "nearly", "four", "gap", "seven"):
        groups = pdf.dropna(subset=[c, "y"]).groupby(c)["y"]
        repeated = groups.size() > 1
        if repeated.any() and (groups.nunique()[repeated] == 1).all():
            want.add((c, "determines target"))
    assert {f for f in found if f[1] == "determines target"} == want == {("half", "determines target"), ("four", "determines target")}


def test_column_matching_over_many_columns(spark):
    """More columns than one word of flags, kinds without a partner, values shared by several columns."""
    left = spark.range(50).select("id", *[(F.col("id") % (k + 2) + k).alias(f"a{k}") for k in range(70)], F.lit(True).alias("flag"))
    right = spark.range(40).select(*[(F.col("id") % (k + 3)).alias(f"b{k}") for k in range(5)], F.lit("x").alias("text"))
    found = {(r["left_column"], r["right_column"]): r["overlap"] for r in merge.match_columns(left, right).collect()}
    lp, rp = left.drop("flag").toPandas(), right.drop("text").toPandas()
    assert set(found) == {(a, b) for a in lp for b in rp}
    for (a, b), overlap in found.items():
        x, y = set(lp[a]), set(rp[b])
        assert overlap == pytest.approx(len(x & y) / len(x | y))
    none = merge.match_columns(left.select("flag"), right.select("text"))
    assert none.count() == 0


def test_keyed_diff_of_a_hot_and_a_null_key(spark, distributed):
    """A third of the rows share one key and many have none: rows are matched by their place, across tasks, as in a plain list."""
    rng = np.random.default_rng(4)

    def rows(edit):
        out = [("hot", int(v), None if v % 5 == 0 else f"t{v % 3}") for v in rng.integers(0, 40, 400)] + [(None, int(v), "n") for v in rng.integers(0, 9, 120)]
        return out + [(f"k{i}", i if i % edit else -1, "u") for i in range(500)] + [("hot", 99, None)] * 30

    first, second = rows(7), rows(11)[40:]
    schema = "k string, x int, `a b` string"
    found = diff.row_changes(spark.createDataFrame(first, schema), spark.createDataFrame(second, schema), ["k"]).collect()

    def grouped(table):
        by_key = {}
        for r in table:
            by_key.setdefault(r[0], []).append(r[1:])
        return {k: sorted(v, key=lambda c: tuple((x is not None, x) if x is not None else (False, 0) for x in c)) for k, v in by_key.items()}

    want, a, b = [], grouped(first), grouped(second)
    for k in a.keys() | b.keys():
        x, y = a.get(k, []), b.get(k, [])
        for i in range(max(len(x), len(y))):
            if i >= len(y) or i >= len(x):
                want.append((k, "removed" if i >= len(y) else "added", None))
            elif x[i] != y[i]:
                want.append((k, "modified", sum(p == q for p, q in zip(x[i], y[i])) / 2))
    assert sorted((tuple(r) for r in found), key=repr) == sorted(want, key=repr)
