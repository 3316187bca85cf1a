from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.normality import shapiro_p
from plumbline.functions.probit import probit_sql
from plumbline.operators import profile, ranks, table1


def by(frame, key="column"):
    return {r[key]: r for r in frame.collect()}


def test_describe_golden(profile_table):
    stats = by(profile.describe(profile_table))
    row = stats["normal_col"]
    assert row["mean"] == pytest.approx(-0.045257, abs=1e-6)
    assert row["std"] == pytest.approx(0.987527, abs=1e-6)
    assert row["q25"] == pytest.approx(-0.698420, abs=1e-6)
    assert row["skew"] == pytest.approx(0.033910, abs=1e-6)
    assert row["kurt"] == pytest.approx(-0.040977, abs=1e-6)
    assert stats["cat_data"]["skew"] == pytest.approx(-3.661486, abs=1e-6)
    assert stats["cat_data"]["kurt"] == pytest.approx(13.038093, abs=1e-6)
    assert stats["nan_data"]["count"] == 0 and stats["nan_data"]["mean"] is None


def test_constant_column_has_zero_shape(spark):
    row = profile.moments(spark.createDataFrame([(3.0,)] * 9, "x double")).first()
    assert (row["std"], row["skew"], row["kurt"]) == (0.0, 0.0, 0.0)


def test_detected_categories(profile_table):
    assert profile.detect_categoricals(profile_table) == {"cat_data": [1, 2, 3, 4], "nan_data": []}
    lazy = by(profile.category_check(profile_table))
    assert {c for c, r in lazy.items() if r["is_categorical"]} == {"cat_data", "nan_data"}


def test_outliers_on_codes(profile_table):
    coded = profile.encode_categories(profile_table, profile.detect_categoricals(profile_table))
    found = by(profile.outlier_counts(coded))
    want = {"normal_col": 1, "non_normal_col": 32, "cat_data": 100, "nan_data": 0, "corr_data": 1, "non_corr_data": 74}
    assert {c: r["outliers"] for c, r in found.items()} == want
    assert (found["cat_data"]["lower"], found["cat_data"]["upper"]) == (3, 3)
    assert (found["nan_data"]["lower"], found["nan_data"]["upper"]) == (-1, -1)


def test_correlations_golden(profile_table):
    coded = profile.encode_categories(profile_table, profile.detect_categoricals(profile_table))
    pairs = {(r["feature_1"], r["feature_2"]): r["r"] for r in profile.correlations(coded).collect()}
    assert pairs["corr_data", "non_corr_data"] == pytest.approx(-0.095358, abs=1e-6)
    assert pairs["normal_col", "cat_data"] == pytest.approx(-0.056641, abs=1e-6)
    assert pairs["normal_col", "nan_data"] is None
    top = profile.top_correlations(coded).collect()
    first = min((r for r in top if r["sign"] == "positive"), key=lambda r: r["rank"])
    assert (first["feature_1"], first["feature_2"]) == ("normal_col", "corr_data")


def test_correlation_ways_agree(profile_table, monkeypatch):
    columns = ["normal_col", "non_normal_col", "cat_data", "nan_data"]
    narrow = {(r["i"], r["j"]): r["r"] for r in profile.correlations(profile_table, columns).collect()}
    monkeypatch.setattr(profile, "GRAM_WIDTH", 1)
    wide = {(r["i"], r["j"]): r["r"] for r in profile.correlations(profile_table, columns).collect()}
    for pair, r in narrow.items():
        assert wide.get(pair) == (None if r is None else pytest.approx(r, abs=1e-9))


def test_correlogram_skips_self_and_adds_target(profile_table):
    found = profile.correlogram(profile_table, "cat_data", ["normal_col", "corr_data", "non_normal_col", "cat_data"], n=1)
    features = {f for r in found.collect() for f in (r["feature_1"], r["feature_2"])}
    assert "cat_data" in features


def test_report_sections(profile_table):
    rows = profile.report(profile_table, "str_data").collect()
    found = {(r["section"], r["column"], r["stat"]): r["value"] for r in rows}
    assert found["shape", "*", "rows"] == "1000"
    assert found["duplicates", "*", "duplicates"] == "0"
    assert found["missing", "nan_data", "missing"] == "1000"
    assert found["missing_rows", "*", "rows_all_missing"] == "0"
    assert found["top_values", "cat_data", "4"] == "900"
    assert "shape" in profile.report_text(profile.report(profile_table))


def test_quantile_ways_agree(spark, distributed, monkeypatch):
    rng = np.random.RandomState(1)
    values = np.where(rng.uniform(size=20_000) < 0.4, 5.0, rng.lognormal(size=20_000))
    table = spark.createDataFrame([(float(v), float(i % 7)) for i, v in enumerate(values)], "x double, y double").cache()
    # a coarse sketch, and one whose brackets are too narrow to hold anything
    for size, reach in ((64, 0.08), (16, 1e-9), (8192, 0.002)):
        monkeypatch.setattr(ranks, "SKETCH_SIZE", size)
        monkeypatch.setattr(ranks, "SKETCH_REACH", reach)
        few = ranks.quantile_map(table, ["x", "y"], [0.0, 0.1, 0.5, 0.77, 1.0])
        np.testing.assert_allclose(few["x"], np.quantile(values, [0.0, 0.1, 0.5, 0.77, 1.0]), rtol=1e-12)
    grid = [i / 40 for i in range(41)]
    many = ranks.quantile_map(table, ["x"], grid)
    np.testing.assert_allclose(many["x"], np.quantile(values, grid), rtol=1e-12)


def test_running_totals_across_ranges(spark, distributed):
    rows = [("a" if i % 3 else "b", i, i % 5) for i in range(500)]
    table = spark.createDataFrame(rows, "g string, o long, x long")
    found = {(r["g"], r["o"]): (r["cum_x"], r["next_o"]) for r in ranks.running(table, ["g"], ["o"], ["x"]).collect()}
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        total = 0
        for here, after in zip(own, own[1:] + [None]):
            total += here[2]
            assert found[g, here[1]] == (total, after[1] if after else None)


def test_moments_far_from_zero(spark):
    """A narrow column far away keeps its shape: sums are taken around its own mean."""
    x = np.random.RandomState(5).gamma(2.0, size=5000)
    row = by(profile.moments(spark.createDataFrame([(float(v) + 1e9, None, 3.5) for v in x], "far double, none double, same double")))
    wanted = pd.Series(x + 1e9 - 1e9)
    assert row["far"]["std"] == pytest.approx(wanted.std(), rel=1e-9) and row["far"]["skew"] == pytest.approx(wanted.skew(), rel=1e-7) and row["far"]["kurt"] == pytest.approx(wanted.kurt(), rel=1e-7)
    assert (row["none"]["count"], row["none"]["mean"], row["none"]["skew"]) == (0, None, None)
    assert (row["same"]["std"], row["same"]["skew"], row["same"]["kurt"]) == (0.0, 0.0, 0.0)


def test_normality_verdicts(spark):
    rng = np.random.RandomState(0)
    table = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.normal(size=1000), rng.exponential(size=1000))], "n double, e double")
    assert table1.normal_columns(table, ["n", "e"]) == ["n"]


def test_normality_of_all_rows(spark):
    """Far values that no small sample holds change the verdict; ties, gaps and odd columns have a defined one."""
    rng = np.random.RandomState(1)
    many = spark.createDataFrame(pd.DataFrame({"k": range(120_000), "x": rng.normal(size=120_000)}))
    with_tail = many.withColumn("y", F.when(F.col("k") % 10_007 == 11, F.col("x") * 40).otherwise(F.col("x")))
    verdict = {r["column"]: r["is_normal"] for r in table1.normality(with_tail, ["x", "y"]).collect()}
    sampled = {r["column"]: r["is_normal"] for r in table1.sampled_normality(with_tail, ["x", "y"], key="k").collect()}
    assert verdict == {"x": True, "y": False} and sampled == {"x": True, "y": True}
    rows = [(0.1, None, 1.0, float(i % 2), 5.0 if i < 2 else None, float("inf") if i == 3 else float(i)) for i in range(40)]
    odd = spark.createDataFrame([(*r, i if i < 4 else None) for i, r in enumerate(rows)], "same double, none double, one double, two double, few double, inf double, four int")
    found = {r["column"]: (r["n"], r["is_normal"]) for r in table1.normality(odd, odd.columns).collect()}
    assert found == {"same": (40, True), "none": (0, False), "one": (40, True), "two": (40, False), "few": (2, False), "inf": (40, False), "four": (4, True)}


def test_normality_statistic_against_plain_scores(spark):
    rng = np.random.RandomState(2)
    values = np.r_[rng.normal(size=300), np.round(rng.normal(size=300), 1)]
    (row,) = table1.normality(spark.createDataFrame([(float(v),) for v in values], "v double"), ["v"]).collect()
    scores = np.array([NormalDist().inv_cdf((i - 0.375) / (len(values) + 0.25)) for i in range(1, len(values) + 1)])
    assert row["w"] == pytest.approx(np.corrcoef(np.sort(values), scores)[0, 1] ** 2, abs=2e-4)
    places = [1e-300, 1e-12, 1e-5, 0.05, 0.075, 0.2, 0.5, 0.6, 0.93, 0.999999]
    found = spark.createDataFrame([(p,) for p in places], "p double").select(F.expr(probit_sql("p"))).collect()
    assert [r[0] for r in found] == pytest.approx([NormalDist().inv_cdf(p) for p in places], rel=1e-13, abs=1e-15)


def test_shapiro_published_example():
    # weights of men, the worked example of Shapiro and Wilk (1965): W = 0.79
    weights = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float)
    assert shapiro_p(weights) == pytest.approx(0.0067, abs=5e-4)


def test_table_one(mixed_table, mixed_frame):
    assert set(table1.partition_columns(mixed_table)[0]) == {"size_class", "maker"}
    counts = mixed_frame["size_class"].value_counts()
    top = sorted(counts.index, key=lambda v: (-counts[v], str(v)))[:5]
    other = {r["value"]: r["n"] for r in table1.top_with_other(mixed_table, ["size_class"]).collect()}
    assert other == {**{str(v): counts[v] for v in top}, "Other": 1000 - counts[top].sum()}
    lines = {r["variable"]: r["summary"] for r in table1.table_one(mixed_table).collect()}
    assert lines[f"<<size_class>> {top[0]}"].startswith(f"{counts[top[0]]}/1000 (")
    assert lines["<<size_class>> Other"].startswith(f"{other['Other']}/1000 (")
    low, mid, high = mixed_frame["size_cubed"].quantile([0.25, 0.5, 0.75])
    shown = [float(x) for x in lines["size_cubed"].replace("(", " ").replace(")", " ").replace(" - ", " ").split()]
    assert shown == pytest.approx([mid, low, high], rel=0.01)
    assert lines["maker"] == ""


def test_nulls_fall_into_other_only_when_lumping(spark):
    many = spark.createDataFrame([(c,) for c in "aabbccddeefg"] + [(None,)], "x string")
    assert {r["value"]: r["n"] for r in table1.top_with_other(many, ["x"]).collect()}["Other"] == 3
    few = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r["value"]: r["n"] for r in table1.top_with_other(few, ["x"]).collect()} == {"a": 1, "b": 1}
