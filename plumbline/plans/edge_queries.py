"""Operators on inputs that are easy to get wrong: null keys and groups, late values, line breaks, codes, names that must stay private."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import balance, diff, models, privacy, profile, reporting, survival, synth
from plumbline.plans.clean_queries import fresh_path
from plumbline.plans.registry import query, rounded, table
from plumbline.sources import files

# public knowledge about the columns, not taken from the rows
CUSTOMER_BOUNDS = {"c_nationkey": (0.0, 24.0), "c_acctbal": (-1000.0, 10000.0)}


@query("csv_line_breaks_documents", "select doc_id, case when text in ('', 'NA', 'N/A', 'null') then null else text end as text, lang from documents")
def _(spark, folder):
    path = fresh_path(spark, "documents")
    table(spark, folder, "documents").select("doc_id", "text", "lang").write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_csv(spark, path)


@query("csv_ward_codes_part", "select p_partkey, p_size || 'D' as code, p_size::double / 2 as half, p_retailprice || 'f' as tag from part")
def _(spark, folder):
    path = fresh_path(spark, "codes")
    code = F.concat(F.col("p_size").cast("string"), F.lit("D"))
    tag = F.concat(F.col("p_retailprice").cast("string"), F.lit("f"))
    table(spark, folder, "part").select("p_partkey", code.alias("code"), (F.col("p_size") / 2).alias("half"), tag.alias("tag")).write.csv(path, header=True)
    return files.read_csv(spark, path)


@query(
    "moments_late_values_lineitem",
    """with t as (select case when l_orderkey > (select max(l_orderkey) / 2 from lineitem) then 1.7e9 + l_quantity end as late, 1e9 + l_linenumber as far from lineitem)
    select 'late' as "column", count(late)::double as count, round(stddev_samp(late - 1.7e9), 6) as std, round(skewness(late - 1.7e9), 5) as skew from t
    union all select 'far', count(far), round(stddev_samp(far - 1e9), 6), round(skewness(far - 1e9), 5) from t""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem")
    half = lines.agg(F.max("l_orderkey") / 2).first()[0]
    late = F.when(F.col("l_orderkey") > half, F.lit(1.7e9) + F.col("l_quantity"))
    found = profile.moments(lines.select(late.alias("late"), (F.lit(1e9) + F.col("l_linenumber")).alias("far")))
    return found.select("column", "count", rounded("std", 6), rounded("skew", 5))


@query(
    "kaplan_meier_null_group_lineitem",
    """with li as (select date_diff('day', date '1992-01-01', l_shipdate::date) as time, l_returnflag = 'R' as died, nullif(l_returnflag, 'N') as g from lineitem),
    c as (select g, time, count(*) filter (died) as events, count(*) as n from li group by 1, 2),
    r as (select *, sum(n) over (partition by g order by time rows between current row and unbounded following) as at_risk from c)
    select g, count(*) as times, sum(events)::bigint as events, max(at_risk)::bigint as at_risk from r group by g""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).alias("days"), (F.col("l_returnflag") == "R").alias("died"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("g"))
    curve = survival.kaplan_meier(lines, "days", F.col("died"), ["g"])
    return curve.groupBy("g").agg(F.count("*").alias("times"), F.sum("events").alias("events"), F.max("at_risk").alias("at_risk"))


@query(
    "subgroup_null_group_lineitem",
    """with p as (select nullif(l_returnflag, 'N') as g, (l_quantity > 25)::int as y, (l_tax > 0.04)::int as z, l_tax as s from lineitem),
    c as (select g, s, sum(y) as pos, sum(1 - y) as neg from p group by 1, 2),
    a as (select g, sum(pos * below) / (sum(pos) * sum(neg)) as auc from (select *, sum(neg) over (partition by g order by s) - neg / 2 as below from c) group by 1)
    select p.g, count(*) as rows, round(avg((y = z)::int), 6) as accuracy, round(any_value(a.auc), 6) as auc from p join a on a.g is not distinct from p.g group by p.g""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.nullif(F.col("l_returnflag"), F.lit("N")).alias("g"), (F.col("l_quantity") > 25).cast("int").alias("y"), (F.col("l_tax") > 0.04).cast("int").alias("z"), F.col("l_tax").alias("s"))
    return models.classification_by_subgroup(lines, "g", "y", "z", "s").select("g", "rows", rounded("accuracy", 6), rounded("auc", 6))


@query(
    "keyed_diff_null_and_repeated_keys_orders",
    """select 'same' as pair, 0::bigint as changes union all
    select 'edited', count(*) from orders where o_orderpriority = '1-URGENT' and o_totalprice > 100000""",
)
def _(spark, folder):
    # an eighth of the keys is null and the rest repeats in pairs
    orders = table(spark, folder, "orders").select(F.when(F.col("o_orderkey") % 8 != 0, F.floor(F.col("o_orderkey") / 8)).alias("k"), "o_orderkey", "o_totalprice", "o_orderpriority")
    edit = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 100000)
    edited = orders.withColumn("o_totalprice", F.when(edit, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")))
    same = diff.row_changes(orders, orders, ["k"]).agg(F.count("*").alias("changes")).select(F.lit("same").alias("pair"), "changes")
    return same.unionByName(diff.row_changes(orders, edited, ["k"]).agg(F.count("*").alias("changes")).select(F.lit("edited").alias("pair"), "changes"))


@query(
    "private_generators_customer",
    """select generator, 2 * count(*) as rows, 0::bigint as real_names, 0::bigint as outside, true as known_levels
    from customer, (values ('dp_marginals'), ('privbayes')) g(generator) group by generator""",
)
def _(spark, folder):
    """The whole table, names and keys among it: no real name comes out, and numbers stay within public bounds."""
    real = table(spark, folder, "customer")
    n = real.count()
    bounds = {**CUSTOMER_BOUNDS, "c_custkey": (0.0, 1e9)}
    options = {g: {"epsilon": 1.0, "bounds": bounds} for g in ("dp_marginals", "privbayes")}
    made = synth.generate(real, "dp_marginals, privbayes", count=n, repeats=2, options=options)
    names = real.select(F.col("c_name").alias("name")).distinct()
    outside = F.lit(False)
    for c, (low, high) in bounds.items():
        outside |= ~F.col(c).between(low, high)
    segments = [r[0] for r in real.select("c_mktsegment").distinct().collect()]
    joined = made.join(names.withColumn("real", F.lit(True)), made["c_name"] == names["name"], "left")
    return joined.groupBy("generator").agg(
        F.count("*").alias("rows"), F.count("real").alias("real_names"), F.count_if(outside).alias("outside"),
        F.bool_and(F.col("c_mktsegment").isNull() | F.col("c_mktsegment").isin(*segments)).alias("known_levels"),
    )


@query(
    "private_budget_customer",
    """select g.generator || ' ' || r.r as release, g.n as spends, 0.9 as epsilon, 0.0 as delta
    from (values ('dp_marginals', 3), ('privbayes', 6)) g(generator, n), (values (0), (1)) r(r) where exists (select 1 from customer)""",
)
def _(spark, folder):
    """The ledger of four private releases of the table: every release spends exactly what it was given."""
    real = table(spark, folder, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    levels = {"c_mktsegment": [r[0] for r in real.select("c_mktsegment").distinct().collect()]}
    options = {g: {"epsilon": 0.9, "bounds": CUSTOMER_BOUNDS, "levels": levels} for g in ("dp_marginals", "privbayes")}
    budget = privacy.Budget(epsilon=3.6)
    synth.generate(real, "dp_marginals, privbayes", count=100, repeats=2, options=options, budget=budget)
    return budget.table(spark).groupBy("release").agg(F.count("*").cast("int").alias("spends"), rounded(F.sum("epsilon"), 9, "epsilon"), rounded(F.sum("delta"), 9, "delta"))


@query(
    "synthetic_properties_customer",
    """select generator, count(*) as rows, true as balance_in_range, true as mean_close, true as segments_known, true as share_close
    from customer, (values ('marginals'), ('gaussian_copula'), ('bayesian_network'), ('sequential_trees')) g(generator) group by generator""",
)
def _(spark, folder):
    """What SQL can say of a generator: rows, range, levels, mean within a quarter of a deviation, largest segment share within 0.15."""
    real = table(spark, folder, "customer")
    facts = real.agg(F.count("*").alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.avg("c_acctbal").alias("mean"), F.stddev("c_acctbal").alias("std")).first()
    shares = {r["c_mktsegment"]: r["count"] / facts["n"] for r in real.groupBy("c_mktsegment").count().collect()}
    made = synth.generate(real, "marginals, gaussian_copula, bayesian_network, sequential_trees", repeats=1, exclude=["c_custkey", "c_name"])
    top = max(sorted(shares), key=shares.get)
    return made.groupBy("generator").agg(
        F.count("*").alias("rows"),
        F.bool_and(F.col("c_acctbal").between(facts["low"], facts["high"])).alias("balance_in_range"),
        (F.abs(F.avg("c_acctbal") - facts["mean"]) < facts["std"] / 4).alias("mean_close"),
        F.bool_and(F.col("c_mktsegment").isin(*shares)).alias("segments_known"),
        (F.abs(F.avg((F.col("c_mktsegment") == top).cast("int")) - shares[top]) < 0.15).alias("share_close"),
    )


@query(
    "generation_report_customer",
    """select generator, (select count(*) from customer) * rows_per as rows, families, gaps_filled from
    (values ('gaussian_copula', 1, 3::bigint, true), ('marginals', 1, 3::bigint, true)) t(generator, rows_per, families, gaps_filled)""",
)
def _(spark, folder):
    """One call: outputs, all score families that need no target, and rows that bring every segment to the largest one."""
    real = table(spark, folder, "customer").drop("c_name")
    report = reporting.generation_report(real, "c_custkey", "gaussian_copula, marginals", repeats=1, fairness="c_mktsegment", quasi=["c_nationkey"], sensitive="c_mktsegment")
    sizes = balance.augmented(real, report.augmentation).groupBy("c_mktsegment").count().agg((F.min("count") == F.max("count")).alias("even")).first()["even"]
    rows = report.outputs.groupBy("generator").agg(F.count("*").alias("rows"))
    families = report.scores.where(F.col("mean").isNotNull()).groupBy("generator").agg(F.count_distinct("family").alias("families"))
    return rows.join(families, "generator").select("generator", "rows", "families", F.lit(sizes).alias("gaps_filled"))
