"""Queries over imputation, balancing, model and synthesis operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import balance, impute, metrics, models, synth
from plumbline.plans.clean_queries import fresh_path
from plumbline.plans.profile_queries import GAPS, lineitem_with_gaps
from plumbline.plans.registry import query, rounded, table
from plumbline.session import materialize
from plumbline.sources import files

# imputation


@query(
    "simple_imputation_lineitem",
    GAPS + """, f as (select avg(l_discount) as m, (select l_returnflag from li where l_returnflag is not null group by 1
 order by count(*) desc, 1 limit 1) as w, (select quantile_cont(l_tax, 0.5) from (select nullif(l_tax, 0.08) as l_tax from li)) as t from li)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(l_discount, m), 6) as l_discount, coalesce(l_returnflag, w) as l_returnflag,
 coalesce(nullif(l_tax, 0.08), t) as l_tax from li, f""",
)
def _(spark, folder):
    lines = lineitem_with_gaps(spark, folder).withColumn("l_tax", F.nullif("l_tax", F.lit(0.08)))
    fills = impute.fit_simple(lines, {"l_discount": "mean", "l_tax": "median", "l_returnflag": "mode"})
    return impute.apply_simple(lines, fills).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded("l_discount", 6), "l_returnflag", "l_tax"
    )


def customer_with_gaps(spark, folder):
    customer = table(spark, folder, "customer").drop("c_name")
    return customer.withColumns(
        {
            "c_acctbal": F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")),
            "c_mktsegment": F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")),
        }
    )


@query("iterative_imputation_customer")
def _(spark, folder):
    filled = impute.impute_iterative(customer_with_gaps(spark, folder), "c_custkey", rounds=2)
    return filled.withColumn("c_acctbal", rounded("c_acctbal", 2))


@query("missing_after_imputation_customer", """select 'c' as "column", count(*) as missing from customer having count(*) < 0""")
def _(spark, folder):
    customer = customer_with_gaps(spark, folder)
    fills = impute.fit_simple(customer, {"c_acctbal": "mean", "c_mktsegment": "mode"})
    return impute.still_missing(impute.apply_simple(customer, fills))


# class balance


CLASSES = "select c_mktsegment, count(*) as n from customer where c_custkey % 3 = 0 or c_mktsegment <> 'BUILDING' group by 1"


def unbalanced(spark, folder):
    return table(spark, folder, "customer").where("c_custkey % 3 = 0 or c_mktsegment <> 'BUILDING'")


def class_counts(df):
    return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("undersample_customer", f"with c as ({CLASSES}) select c_mktsegment, (select min(n) from c) as n from c")
def _(spark, folder):
    return class_counts(balance.undersample(unbalanced(spark, folder), "c_mktsegment", "c_custkey"))


@query("oversample_customer", f"with c as ({CLASSES}) select c_mktsegment, (select max(n) from c) as n from c")
def _(spark, folder):
    return class_counts(balance.oversample(unbalanced(spark, folder), "c_mktsegment", "c_custkey"))


@query("smote_customer", f"with c as ({CLASSES}) select c_mktsegment, (select max(n) from c) as n from c")
def _(spark, folder):
    made = balance.smote(unbalanced(spark, folder), "c_mktsegment", "c_custkey", ["c_nationkey", "c_acctbal"])
    return class_counts(made)


@query("combined_balance_customer", f"with c as ({CLASSES}) select c_mktsegment, cast((select round_even(avg(n), 0) from c) as bigint) as n from c")
def _(spark, folder):
    made = balance.combine(unbalanced(spark, folder), "c_mktsegment", "c_custkey", ["c_nationkey", "c_acctbal"])
    return class_counts(made)


@query("fairness_augmentation_customer", f"with c as ({CLASSES}) select c_mktsegment, (select max(n) from c) as n from c")
def _(spark, folder):
    real = unbalanced(spark, folder).drop("c_custkey", "c_name")
    extra = balance.fairness_augmentation(real, "c_mktsegment", synth.group_generator("marginals"))
    return class_counts(balance.augmented(real, extra))


# studies


def order_features(spark, folder):
    """Late orders with a learnable target; a hash of the key splits train and test."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year")
    )
    noise = balance.uniform(5, "o_orderkey")
    signal = F.col("o_totalprice") / 500000 + F.col("month") / 24 + noise / 2
    labelled = orders.withColumns({"expensive": (signal > 1.0).cast("string"), "effort": signal * 100})
    train = balance.uniform(1, "o_orderkey") < 0.7
    return labelled.where(train), labelled.where(~train)


@query("classification_study_orders")
def _(spark, folder):
    train, test = order_features(spark, folder)
    study = models.classification_study(
        train.drop("effort"), test.drop("effort"), "expensive", exclude=["o_orderkey"], folds=2, candidates=("linear_model", "xgb")
    )
    return study.scores


@query("regression_study_orders")
def _(spark, folder):
    train, test = order_features(spark, folder)
    study = models.regression_study(
        train.drop("expensive"), test.drop("expensive"), "effort", exclude=["o_orderkey"], folds=2, candidates=("linear_model", "xgb")
    )
    return study.scores


@query("survival_study_lineitem")
def _(spark, folder):
    joined = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    life = joined.where("l_shipdate > o_orderdate").select(
        F.datediff("l_shipdate", "o_orderdate").alias("days"), (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        "l_quantity", "l_discount", "l_linestatus", F.xxhash64("l_orderkey", "l_linenumber").alias("k"),
    )
    train = balance.uniform(1, "k") < 0.7
    return models.survival_study(life.where(train), life.where(~train), "days", "returned", exclude=["k"]).scores


@query(
    "concordance_customer",
    """with c as (select c_custkey, c_nationkey as t, c_custkey % 3 <> 0 as e, floor(c_acctbal / 100) as s from customer),
 p as (select a.s as sa, b.s as sb from c a, c b where a.e and a.t < b.t)
 select count(*) as comparable, count(*) filter (sa > sb) as concordant, count(*) filter (sa = sb) as tied,
 round((count(*) filter (sa > sb) + count(*) filter (sa = sb) / 2) / count(*), 6) as concordance from p""",
)
def _(spark, folder):
    df = table(spark, folder, "customer").select("c_nationkey", "c_custkey", F.floor(F.col("c_acctbal") / 100).alias("risk"))
    found = models.concordance(df, "c_nationkey", F.col("c_custkey") % 3 != 0, "risk")
    return found.withColumn("concordance", rounded("concordance", 6))


GUESS = "(l_quantity * 1500 + l_discount * 1000)"


@query(
    "conformal_intervals_lineitem",
    f"""with c as (select abs(l_extendedprice - {GUESS}) as s from lineitem where l_linenumber % 2 = 1),
 n as (select cast(ceil((count(*) + 1) * 0.9 - 1e-12) as bigint) as k from c),
 q as (select s from (select s, row_number() over (order by s) as rn from c), n where rn = k)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, round({GUESS} - s, 4) as lower, round({GUESS} + s, 4) as upper
 from lineitem, q where l_linenumber % 2 = 0""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("guess", F.col("l_quantity") * 1500 + F.col("l_discount") * 1000)
    calibration, rest = lines.where("l_linenumber % 2 = 1"), lines.where("l_linenumber % 2 = 0")
    found = models.conformal_intervals(calibration, rest, "guess", "l_extendedprice")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded("lower", 4), rounded("upper", 4))


@query(
    "conformal_survival_lineitem",
    """with li as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', o_orderdate, l_shipdate) as days, l_returnflag = 'R' as returned,
  40 + l_quantity * 0.5 as guess from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate),
 cal as (select days, returned, days / guess as s from li where l_linenumber % 2 = 1),
 t as (select days, count(*) filter (returned) as d, count(*) filter (not returned) as c, count(*) as n from cal group by 1),
 r as (select *, sum(n) over (order by days rows between current row and unbounded following) - d as at_risk from t),
 g as (select days, 1 / coalesce(product(case when c < at_risk then 1 - c / at_risk::double else 1 end) over (order by days rows between unbounded preceding and 1 preceding), 1) as w from r),
 m as (select s, sum(w) as w, max(w) as most from cal join g using (days) where returned group by s),
 o as (select s, sum(w) over (order by s) as upto, sum(w) over (order by s desc) as above, sum(w) over () as total, max(most) over () as most from m),
 q as (select coalesce(max(case when above >= 0.9 * (total + most) * (1 - 1e-12) then s end), 0) as low, min(case when upto >= 0.9 * (total + most) * (1 - 1e-12) then s end) as high from o)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, days, returned, round(guess * low, 4) as lower, round(guess * high, 4) as upper from li, q where l_linenumber % 2 = 0""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.datediff("l_shipdate", "o_orderdate").alias("days"), (F.col("l_returnflag") == "R").alias("returned"), (40 + F.col("l_quantity") * 0.5).alias("guess"))
    calibration, rest = lines.where("l_linenumber % 2 = 1"), lines.where("l_linenumber % 2 = 0")
    found = models.conformal_survival(calibration, rest, "guess", "days", F.col("returned"), alpha=0.2)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "days", "returned", rounded("lower", 4), rounded("upper", 4))


@query(
    "conformal_sets_lineitem",
    """with p as (select *, l_discount * 5 + 0.2 as p1, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem),
 c as (select 1 - case y when 1 then p1 else 1 - p1 end as s from p where l_linenumber % 2 = 1),
 n as (select cast(ceil((count(*) + 1) * 0.8 - 1e-12) as bigint) as k from c),
 q as (select s from (select s, row_number() over (order by s) as rn from c), n where rn = k)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', case when 1 - (1 - p1) <= s then '0' end, case when 1 - p1 <= s then '1' end)
 as prediction_set from p, q where l_linenumber % 2 = 0""",
)
def _(spark, folder):
    p1 = F.col("l_discount") * 5 + 0.2
    lines = table(spark, folder, "lineitem").withColumns(
        {"p": F.array(1 - p1, p1), "y": F.when(F.col("l_returnflag") == "R", 1).otherwise(0)}
    )
    found = models.conformal_sets(lines.where("l_linenumber % 2 = 1"), lines.where("l_linenumber % 2 = 0"), "p", "y", alpha=0.2)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("prediction_set", ",").alias("prediction_set"))


@query(
    "subgroup_classification_lineitem",
    """with p as (select l_linestatus as g, (l_returnflag = 'R')::int as y, l_discount * 10 + l_tax as s,
 (l_discount * 10 + l_tax > 0.5)::int as z from lineitem), c as (select g, s, sum(y) as pos, sum(1 - y) as neg from p group by 1, 2),
 a as (select g, sum(pos * below) / (sum(pos) * sum(neg)) as auc from (select *, sum(neg) over (partition by g order by s) - neg / 2 as below from c) group by 1),
 m as (select g, count(*) as rows, avg((y = z)::int) as accuracy, sum(y * z) as tp, sum((1 - y) * z) as fp, sum(y * (1 - z)) as fn from p group by 1)
 select g as l_linestatus, rows, round(accuracy, 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall,
 round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(auc, 6) as auc from m join a using (g)""",
)
def _(spark, folder):
    score = F.col("l_discount") * 10 + F.col("l_tax")
    lines = table(spark, folder, "lineitem").withColumns(
        {"y": (F.col("l_returnflag") == "R").cast("int"), "s": score, "z": (score > 0.5).cast("int")}
    )
    found = models.classification_by_subgroup(lines, "l_linestatus", "y", "z", "s")
    return found.select("l_linestatus", "rows", *[rounded(c, 6) for c in ("accuracy", "precision", "recall", "f1", "auc")])


@query(
    "subgroup_regression_lineitem",
    f"""with p as (select l_returnflag as g, l_extendedprice as y, l_extendedprice - {GUESS} as e from lineitem)
 select g as l_returnflag, count(*) as rows, round(sqrt(avg(e * e)), 4) as rmse, round(avg(abs(e)), 4) as mae,
 round(1 - avg(e * e) / var_pop(y), 6) as r2 from p group by 1""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("guess", F.col("l_quantity") * 1500 + F.col("l_discount") * 1000)
    found = models.regression_by_subgroup(lines, "l_returnflag", "l_extendedprice", "guess")
    return found.select("l_returnflag", "rows", rounded("rmse", 4), rounded("mae", 4), rounded("r2", 6))


@query("permutation_importance_orders")
def _(spark, folder):
    train, test = (frame.drop("expensive") for frame in order_features(spark, folder))
    study = models.regression_study(train, test, "effort", exclude=["o_orderkey"], folds=0, candidates=("linear_model",))
    r2 = lambda p: models.regression_by_subgroup(p.withColumn("g", F.lit(1)), "g", "effort", models.PREDICTION).first()["r2"]
    return models.permutation_importance(study.predict, test, "o_orderkey", ["o_totalprice", "month", "year"], r2)


@query("attribution_ranking_orders")
def _(spark, folder):
    train, test = (frame.drop("expensive") for frame in order_features(spark, folder))
    study = models.regression_study(train, test, "effort", exclude=["o_orderkey"], folds=0, candidates=("linear_model",))
    score = lambda df: study.predict(df).withColumn("score", F.col(models.PREDICTION))
    return models.shapley_ranking(score, test, "o_orderkey", ["o_totalprice", "month", "year"], rounds=3)


@query("feature_selection_orders")
def _(spark, folder):
    train, _ = order_features(spark, folder)
    return models.select_features(train.drop("effort"), "expensive", "o_orderkey", rounds=8)


@query("sample_hardness_orders")
def _(spark, folder):
    train, _ = order_features(spark, folder)
    found = models.sample_hardness(train.drop("effort"), "expensive", "o_orderkey", checkpoints=6)
    return found.groupBy("hardness").agg(F.count("*").alias("n"), rounded(F.avg("confidence"), 4, "confidence"))


@query("hardness_filter_orders")
def _(spark, folder):
    train, test = order_features(spark, folder)
    return models.hardness_effect(train.drop("effort"), test.drop("effort"), "expensive", "o_orderkey", 0.2)


@query("weak_regions_orders")
def _(spark, folder):
    train, test = order_features(spark, folder)
    return models.weak_regions(train, test, "o_orderkey", ["o_totalprice", "month", "year", "effort"])


# synthesis


def real_customers(spark, folder):
    return table(spark, folder, "customer").drop("c_custkey", "c_name")


@query("generator_catalogue_run_customer")
def _(spark, folder):
    made = synth.generate(real_customers(spark, folder), "marginals, gaussian_copula", repeats=2)
    named = synth.catalogue(spark, privacy=True).withColumnRenamed("name", "generator")
    counts = made.groupBy("generator", "repeat").agg(F.count("*").alias("rows"), rounded(F.avg("c_acctbal"), 2, "mean_balance"))
    return counts.join(F.broadcast(named), "generator")


def synthetic(method: str, **options):
    def run(spark, folder):
        made = synth.GENERATORS[method][1](real_customers(spark, folder), table(spark, folder, "customer").count(), seed=1, **options)
        return made.withColumn("c_acctbal", rounded("c_acctbal", 2))

    return run


PUBLIC = {"bounds": {"c_nationkey": (0.0, 24.0), "c_acctbal": (-1000.0, 10000.0)}}

for _method, (_category, _) in synth.GENERATORS.items():
    query(f"synthetic_{_method}_customer")(synthetic(_method, **(PUBLIC if _category == "privacy" else {})))


@query("synthetic_projection_customer")
def _(spark, folder):
    real = real_customers(spark, folder)
    made = synth.sample_copula(real, real.count(), seed=1)
    found = synth.projection(real, made)
    return found.select("source", rounded("x", 6), rounded("y", 6))


@query("synthetic_scores_customer")
def _(spark, folder):
    real = table(spark, folder, "customer").drop("c_name")
    parts = []
    for method in ("marginals", "gaussian_copula"):
        for repeat in range(3):
            made = synth.GENERATORS[method][1](real.drop("c_custkey"), real.count(), seed=repeat)
            made = materialize(made.withColumnRenamed("syn_id", "c_custkey"))
            family = metrics.evaluate_marginals(real, made, "c_custkey")
            parts.append(family.select(F.lit(method).alias("generator"), F.lit(repeat).alias("repeat"), "*"))
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.unionByName(part)
    return metrics.score_table(scores)


def utility_tables(spark, folder):
    train, test = (frame.drop("effort") for frame in order_features(spark, folder))
    made = synth.sample_trees(train.drop("o_orderkey"), train.count(), seed=1).withColumnRenamed("syn_id", "o_orderkey")
    # the studies read their tables several times, so the generated one is written once
    return train, materialize(made), test


@query("synthetic_utility_orders")
def _(spark, folder):
    train, made, test = utility_tables(spark, folder)
    return models.performance(train, made, test, "expensive", exclude=["o_orderkey"])


@query("augmentation_utility_orders")
def _(spark, folder):
    train, test = (frame.drop("effort") for frame in order_features(spark, folder))
    extra = balance.fairness_augmentation(train.drop("o_orderkey"), "expensive", synth.group_generator("gaussian_copula"))
    return models.augmentation_performance(train, materialize(extra), test, "expensive", exclude=["o_orderkey"])


@query(
    "synthetic_sink_customer",
    """select generator, 0 as repeat, (select count(*) from customer) as rows from (values ('marginals'), ('dp_marginals')) t(generator)""",
)
def _(spark, folder):
    made = synth.generate(real_customers(spark, folder), "marginals,dp_marginals", repeats=1, options={"dp_marginals": PUBLIC})
    path = files.save_by_generator(made, fresh_path(spark, "synthetic"), ["generator", "repeat"])
    return spark.read.parquet(path).groupBy("generator", "repeat").agg(F.count("*").alias("rows"))
