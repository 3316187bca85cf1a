from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.special import chi2_tail
from plumbline.operators import balance, impute, metrics, models, neighbours, privacy, survival, synth, valuation


def points(spark, n, dim=3, seed=0, hot=0.3):
    """Random vectors of which a third sit on one spot."""
    rng = np.random.RandomState(seed)
    x = rng.normal(size=(n, dim))
    x[: int(n * hot)] = 0.5
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")


def brute_knn(a, b, k, skip):
    out = {}
    for i, row in enumerate(a):
        d = np.sqrt(((b - row) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(b)), d)) if not (skip and j == i)][:k]
        out[i] = [(j, d[j]) for j in order]
    return out


@pytest.mark.parametrize("skip", [True, False])
def test_neighbours_with_a_hot_spot(spark, distributed, monkeypatch, skip):
    monkeypatch.setattr(neighbours, "MOST_PIVOTS", 7)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 60)
    x, table = points(spark, 400)
    found = {}
    for r in neighbours.knn(table, table, 4, skip_same_id=skip).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["base_id"], r["distance"]))
    for i, want in brute_knn(x, x, 4, skip).items():
        got = sorted(found[i])
        assert [g[1] for g in got] == [w[0] for w in want]
        np.testing.assert_allclose([g[2] for g in got], [w[1] for w in want], atol=1e-12)


def test_ball_counts_both_ways(spark, distributed, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_PIVOTS", 5)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    x, table = points(spark, 300)
    radii = 0.3 + np.arange(300) / 1000
    base = table.withColumn("radius", 0.3 + F.col("id") / 1000)
    found = {r["query_id"]: r["n"] for r in neighbours.ball_counts(table, base, "radius").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = (d <= radii[None]).sum(axis=1)
    assert {i: int(n) for i, n in enumerate(want) if n} == found


def test_shapley_ways_agree(spark, distributed):
    rng = np.random.RandomState(2)
    x, y = rng.normal(size=(30, 2)), rng.randint(0, 2, 30)
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(30)]
    table = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    train, test = table.where("id < 25"), table.where("id >= 25")
    exact = {r["id"]: r["value"] for r in valuation.knn_shapley(train, test, 3).collect()}
    want = np.zeros(25)
    for t in range(25, 30):
        order = np.lexsort((np.arange(25), np.sqrt(((x[:25] - x[t]) ** 2).sum(axis=1))))
        m = (y[order] == y[t]).astype(float)
        s = np.zeros(25)
        s[24] = m[24] * min(3, 25) / 3 / 25
        for i in range(23, -1, -1):
            s[i] = s[i + 1] + (m[i] - m[i + 1]) / 3 * min(3, i + 1) / (i + 1)
        want[order] += s / 5
    np.testing.assert_allclose([exact[i] for i in range(25)], want, atol=1e-12)
    near = {r["id"]: r["value"] for r in valuation.knn_shapley_within(train, test, 3, 0.1).collect()}
    assert max(abs(near[i] - exact[i]) for i in exact) <= 0.1


def test_survival_hits_zero(spark):
    rows = [(1.0, True), (2.0, False), (3.0, True), (3.0, True)]
    curve = survival.kaplan_meier(spark.createDataFrame(rows, "t double, e boolean"), "t", F.col("e")).orderBy("time").collect()
    assert [(r["time"], r["at_risk"], r["survival"]) for r in curve] == [(1.0, 4, 0.75), (2.0, 3, 0.75), (3.0, 2, 0.0)]


def test_concordance_brute_force(spark, distributed):
    rng = np.random.RandomState(4)
    t, e, s = rng.randint(0, 40, 200), rng.uniform(size=200) < 0.6, rng.randint(0, 10, 200)
    table = spark.createDataFrame([(int(a), bool(b), float(c)) for a, b, c in zip(t, e, s)], "t long, e boolean, s double")
    row = models.concordance(table, "t", F.col("e"), "s").first()
    pairs = [(i, j) for i in range(200) for j in range(200) if e[i] and t[i] < t[j]]
    assert row["comparable"] == len(pairs)
    assert row["concordant"] == sum(s[i] > s[j] for i, j in pairs)
    assert row["tied"] == sum(s[i] == s[j] for i, j in pairs)


def test_chi_squared_tail():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert chi2_tail(2.0, 4) == pytest.approx(0.7357588823, abs=1e-9)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.RandomState(5)
    rows = [(i, float(a), float(b), "pq"[i % 2]) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    return spark.createDataFrame(rows, "id long, a double, b double, s string").cache()


def test_scores_of_identical_tables(scored):
    found = {r["metric"]: r["value"] for r in metrics.evaluate(scored, scored, "id", quasi=["s"], sensitive="s").collect()}
    ideal = {
        "data_mismatch": 0, "common_rows_proportion": 1, "nearest_syn_neighbor_distance": 0, "close_values_probability": 1,
        "jensenshannon_dist": 0, "inv_kl_divergence": 1, "chi_squared_test": 1, "feature_corr": 0, "ks_test": 1,
        "wasserstein_dist": 0, "max_mean_discrepancy": 0, "precision": 1, "recall": 1, "coverage": 1, "delta_presence": 1, "k_map": 150,
    }
    for name, value in ideal.items():
        assert found[name] == pytest.approx(value, abs=1e-9), name
    assert found["identifiability_score"] == 1.0
    assert found["authenticity"] == 0.0


def test_mean_discrepancy_close_to_exact(spark, scored):
    other = scored.withColumn("a", F.col("a") + 1.0)
    got = metrics.mean_discrepancy(scored, other, ["a", "b"]).first()[0]
    scale = neighbours.min_max(scored, ["a", "b"])
    x = np.array([r["v"] for r in scored.select(neighbours.as_vector(["a", "b"], scale).alias("v")).collect()])
    y = np.array([r["v"] for r in other.select(neighbours.as_vector(["a", "b"], scale).alias("v")).collect()])
    kernel = lambda p, r: np.exp(-0.5 * ((p[:, None] - r[None]) ** 2).sum(axis=2)).mean()
    assert got == pytest.approx(kernel(x, x) + kernel(y, y) - 2 * kernel(x, y), abs=2e-3)


def test_imputation_contract(spark, gaps_frame):
    from plumbline.operators.common import nan_to_null

    table = nan_to_null(spark.createDataFrame(gaps_frame))
    filled = impute.impute_iterative(table, "id", rounds=2).toPandas().sort_values("id", ignore_index=True)
    assert filled["rising"][470] == pytest.approx(1417, rel=0.1)
    for c in ("balance", "nation"):
        assert filled[c].mean() == pytest.approx(gaps_frame[c].mean(), rel=0.01)
        assert filled[c].std() == pytest.approx(gaps_frame[c].std(), rel=0.1)
    for c in ("rising", "balance", "nation"):
        known = gaps_frame[c].notna()
        assert (filled[c][known] == gaps_frame[c][known]).all()
    assert impute.still_missing(spark.createDataFrame(filled)).count() == 0


def test_balancing(spark):
    table = spark.createDataFrame([(i, float(i), "c" if i % 10 == 0 else "d" if i % 3 == 0 else "e") for i in range(200)], "id long, x double, y string")
    count = lambda f: {r["y"]: r["count"] for r in f.groupBy("y").count().collect()}
    sizes = count(table)
    assert set(count(balance.undersample(table, "y", "id")).values()) == {min(sizes.values())}
    over = balance.oversample(table, "y", "id")
    assert set(count(over).values()) == {max(sizes.values())}
    copies = [r["count"] for r in over.where("y = 'c'").groupBy("id").count().collect()]
    assert max(copies) - min(copies) <= 1
    made = balance.smote(table, "y", "id", ["x"], k=3)
    assert set(count(made).values()) == {max(sizes.values())}
    bounds = table.groupBy("y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    assert made.join(bounds, "y").where("x < lo or x > hi").count() == 0
    assert balance.undersample(table, "y", "id").exceptAll(balance.undersample(table, "y", "id")).count() == 0


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.RandomState(6)
    x = rng.normal(size=800)
    rows = [(float(v), int(round(v * 3 + w)), "hi" if v > 0 else "lo", f"name {i}") for i, (v, w) in enumerate(zip(x, rng.normal(size=800)))]
    return spark.createDataFrame(rows, "x double, n int, s string, name string").cache()


@pytest.mark.parametrize("method", sorted(synth.GENERATORS))
def test_generators(people, method):
    category, generator = synth.GENERATORS[method]
    # at the default budget the noise drowns a table of 800 rows; a loose one keeps the shape
    make = partial(generator, epsilon=50.0, bounds={"x": (-4.0, 4.0), "n": (-15.0, 15.0)}) if category == "privacy" else generator
    made = make(people, 1200, seed=3).cache()
    assert made.count() == 1200
    assert dict(made.drop("syn_id").dtypes) == dict(people.dtypes)
    if category == "privacy":  # its noise cannot be drawn again
        first, second = (make(people, 400, seed=3, epsilon=1.0).cache() for _ in range(2))
        assert first.exceptAll(second).count() > 0
    else:
        assert made.exceptAll(make(people, 1200, seed=3)).count() == 0
    real, syn = people.agg(F.avg("x"), F.stddev("x")).first(), made.agg(F.avg("x"), F.stddev("x")).first()
    assert syn[0] == pytest.approx(real[0], abs=0.35) and syn[1] == pytest.approx(real[1], rel=0.4)
    assert {r["s"] for r in made.select("s").distinct().collect()} <= ({"hi", "lo", None} if category == "privacy" else {"hi", "lo"})
    # names are all different: they are real ones where nothing is private, and stay out where it is
    real_names = made.join(people, "name", "left_semi").count()
    assert real_names == (0 if category == "privacy" else 1200)
    if method in ("gaussian_copula", "bayesian_network", "sequential_trees"):
        assert made.select(F.corr("x", "n")).first()[0] > 0.6


def test_private_generators_need_public_bounds(people):
    for method in ("dp_marginals", "privbayes"):
        with pytest.raises(ValueError, match="public bounds"):
            synth.GENERATORS[method][1](people, 10)
    levels = {"s": ["hi", "lo", "none"], "name": ["a", "b"]}
    made = synth.sample_private_marginals(people, 500, epsilon=100.0, bounds={"x": (-4.0, 4.0), "n": (-15.0, 15.0)}, levels=levels).cache()
    assert {r["s"] for r in made.select("s").distinct().collect()} <= {"hi", "lo", "none", None}
    # no real name is among the public levels: all cells count as missing
    assert made.where("name is not null").count() <= 25


def test_private_budget_is_kept(people):
    """Spends of all repeats add up to what was asked for, and a ledger that is used up stops the next release."""
    options = {g: {"epsilon": e, "bounds": {"x": (-4.0, 4.0), "n": (-15.0, 15.0)}, "levels": {"s": ["hi", "lo"]}} for g, e in (("dp_marginals", 0.5), ("privbayes", 2.0))}
    budget = privacy.Budget(epsilon=7.5, delta=1e-5)
    synth.generate(people, "dp_marginals, privbayes", count=20, repeats=3, options=options, budget=budget).count()
    rows = {}
    for release, _, epsilon, _ in budget.spends:
        rows[release] = rows.get(release, 0.0) + epsilon
    assert set(rows) == {f"{g} {k}" for g in options for k in range(3)}
    # a text without public levels whose levels stay hidden spends nothing on its cells
    assert all(v <= (0.5 if r.startswith("dp") else 2.0) + 1e-9 for r, v in rows.items()) and budget.spent[1] == pytest.approx(6 * synth.DELTA)
    with pytest.raises(ValueError, match="beyond the budget"):
        synth.generate(people, "privbayes", count=20, repeats=3, options=options, budget=budget)


def test_private_mechanisms():
    source = privacy.secret_source()
    noise = privacy.noisy_counts(np.zeros(200_000), 0.5, source)
    assert (noise == np.round(noise)).all() and abs(noise.mean()) < 0.1 and np.abs(noise).mean() == pytest.approx(4.0, rel=0.05)
    drawn = np.bincount([privacy.exponential_choice(np.array([0.0, 1.0, 2.0]), 2.0, 1.0, source) for _ in range(30_000)], minlength=3) / 30_000
    wanted = np.exp([0.0, 1.0, 2.0]) / np.exp([0.0, 1.0, 2.0]).sum()
    np.testing.assert_allclose(drawn, wanted, atol=0.015)
    scores = {(i, j): float(10 * (j == i - 1)) for i in range(5) for j in range(i)}
    assert privacy.private_tree(scores, 5, 400.0, 1000, source) == [(0, None), (1, 0), (2, 1), (3, 2), (4, 3)]
    # the sensitivity bounds what one row can do
    table = np.array([[30, 3], [5, 22]])
    n = int(table.sum())
    for a in np.ndindex(2, 2):
        for b in np.ndindex(2, 2):
            if table[a] and a != b:
                moved = table.copy()
                moved[a] -= 1
                moved[b] += 1
                assert abs(synth.mutual_information(moved) - synth.mutual_information(table)) <= privacy.information_sensitivity(n)


def test_method_list_is_trimmed():
    assert synth.method_names("Marginals, privbayes ") == ["marginals", "privbayes"]
    with pytest.raises(ValueError):
        synth.method_names("nothing")


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_feature_selection_keeps_the_drivers(spark, late_shipments, shipment_effort, task):
    frame = late_shipments if task == "classification" else shipment_effort
    found = models.select_features(spark.createDataFrame(frame), "target", "id", task, rounds=10).collect()
    assert {"quantity", "discount", "line"} <= {r["feature"] for r in found if r["selected"]}


def test_attribution_order(spark, late_shipments):
    table = spark.createDataFrame(late_shipments).withColumn("target", F.col("target").cast("string"))
    study = models.classification_study(table, table, "target", exclude=["id"], folds=0, candidates=("forest",))
    score = lambda df: study.predict(df).withColumn("score", F.col(models.PROBABILITY)[1])
    found = models.shapley_ranking(score, table.drop("target"), "id", ["quantity", "discount", "tax", "part", "line"], rounds=3)
    order = [r["feature"] for r in found.orderBy(F.desc("mean_abs_attribution")).collect()]
    assert order[:3] == ["quantity", "discount", "line"]


def test_permutation_importance_and_minimum(spark, shipment_effort):
    table = spark.createDataFrame(shipment_effort)
    study = models.regression_study(table, table, "target", exclude=["id"], folds=0, candidates=("linear_model",))
    r2 = lambda p: models.regression_by_subgroup(p.withColumn("g", F.lit(1)), "g", "target", models.PREDICTION).first()["r2"]
    found = {r["feature"]: r["importance"] for r in models.permutation_importance(study.predict, table, "id", ["quantity", "discount", "tax", "line"], r2).collect()}
    assert min(found["quantity"], found["discount"], found["line"]) > 10 * abs(found["tax"])
    with pytest.raises(ValueError, match="below the required"):
        models.regression_study(table, table, "target", exclude=["id"], folds=0, candidates=("linear_model",), minimum=1.1)


def test_permutation_moves_rows_as_a_whole(spark, distributed):
    table = spark.range(100).select("id", (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"))
    mixed = models.permuted(table, "id", ["a", "b"], seed=1)
    assert mixed.count() == 100
    assert mixed.where("_p_a * 3 <> _p_b * 2").count() == 0
    assert mixed.where("_p_a = a").count() == 0
    assert mixed.select("_p_a").distinct().count() == 100


def test_conformal_coverage(spark):
    rng = np.random.RandomState(7)
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=2000))], "id long, y double").withColumn("p", F.lit(0.0))
    calibration, rest = table.where("id < 1000"), table.where("id >= 1000")
    made = models.conformal_intervals(calibration, rest, "p", "y")
    assert made.select(F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("int"))).first()[0] == pytest.approx(0.9, abs=0.03)
    few = models.conformal_intervals(table.limit(5), rest, "p", "y")
    assert few.first()["upper"] == float("inf")


def test_hardness_grades(spark, late_shipments):
    frame = late_shipments.copy()
    flipped = frame["id"] % 25 == 0
    frame.loc[flipped, "target"] = 1 - frame.loc[flipped, "target"]
    table = spark.createDataFrame(frame)
    found = models.sample_hardness(table, "target", "id").join(table.select("id", (F.col("id") % 25 == 0).alias("flipped")), "id")
    mean = {r["flipped"]: r["c"] for r in found.groupBy("flipped").agg(F.avg("confidence").alias("c")).collect()}
    assert mean[True] < mean[False] - 0.2
    kept = models.filter_hard(table, found.drop("flipped"), "id", 1.0)
    assert kept.count() == found.where("hardness = 'easy'").count()


def test_weak_regions_flag_broken_rows(spark, shipment_effort):
    frame = shipment_effort[["id", "quantity", "discount", "target"]].copy()
    frame.loc[frame["id"] == 7, "target"] += 500
    table = spark.createDataFrame(frame)
    worst = models.weak_regions(table.where("id <> 7"), table.where("id < 50"), "id", ["quantity", "discount", "target"]).first()
    assert worst["id"] == 7


def test_conformal_survival_covers_true_times(spark):
    """Half of the rows are censored; the interval still covers the times that would have been seen without censoring."""
    rng = np.random.default_rng(8)
    n = 4000
    size = rng.uniform(1, 5, n)
    true = size * rng.exponential(1.0, n)
    limit = rng.exponential(4.0, n)
    rows = [(int(k % 2), float(p), float(min(t, c)), bool(t <= c), float(t)) for k, (p, t, c) in enumerate(zip(size, true, limit))]
    table = spark.createDataFrame(rows, "half int, guess double, seen double, event boolean, true_time double")
    found = models.conformal_survival(table.where("half = 0"), table.where("half = 1"), "guess", "seen", F.col("event"), alpha=0.3)
    share, below = found.agg(F.avg((F.col("true_time").between(F.col("lower"), F.col("upper"))).cast("double")), F.avg((F.col("true_time") < F.col("lower")).cast("double"))).first()
    assert 0.66 <= share <= 0.76 and 0.12 <= below <= 0.18
    naive = models.weighted_limits(table.where("half = 0 and event").withColumn("s", F.col("seen") / F.col("guess")).withColumn("w", F.lit(1.0)), "s", "w", 0.15)
    weighted = found.agg(F.max(F.col("upper") / F.col("guess"))).first()[0]
    assert weighted > naive[1] * 1.1  # without weights long times are too rare


def test_conformal_survival_edges(spark):
    schema = "guess double, seen double, event boolean"
    ask = spark.createDataFrame([(2.0, None, None)], schema)
    for rows in ([], [(1.0, 3.0, False)], [(1.0, 3.0, True)], [(None, 3.0, True), (1.0, None, True), (1.0, 2.0, None), (0.0, 1.0, True)]):
        (r,) = models.conformal_survival(spark.createDataFrame(rows, schema), ask, "guess", "seen", F.col("event")).collect()
        assert (r["lower"], r["upper"]) == (0.0, float("inf"))
    weights = survival.censoring_weights(spark.createDataFrame([(1.0, 1.0, True), (1.0, 1.0, False), (1.0, 2.0, True), (1.0, 3.0, False)], schema), "seen", F.col("event"))
    assert sorted((r["time"], round(r["weight"], 9)) for r in weights.collect()) == [(1.0, 1.0), (2.0, 1.5), (3.0, 1.5)]
