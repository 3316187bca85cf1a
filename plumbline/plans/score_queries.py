"""Queries over survival, valuation, neighbour and scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import metrics, neighbours, survival, valuation

from plumbline.plans.profile_queries import each
from plumbline.plans.registry import query, rounded, table

# A deterministic second version of ``customer``: every row shifted, so that scores are exact and not trivial.
SYN_COLUMNS = ["c_nationkey", "c_acctbal"]


def customer_pair(spark, folder):
    real = table(spark, folder, "customer")
    shift = (F.col("c_custkey") * 7919) % 1001 - 400
    segment = F.when(F.col("c_custkey") % 10 == 0, F.lit("BUILDING")).otherwise(F.col("c_mktsegment"))
    syn = real.withColumns(
        {
            "c_acctbal": F.round(F.col("c_acctbal") * 0.9 + F.when(F.col("c_custkey") % 3 != 0, shift).otherwise(0), 2),
            "c_nationkey": ((F.col("c_nationkey") + F.col("c_custkey") % 4) % 25).cast("int"),
            "c_mktsegment": segment,
        }
    )
    return real, syn


PAIR = """with real as (select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer), syn as (select c_custkey,
 cast((c_nationkey + c_custkey % 4) % 25 as integer) as c_nationkey,
 round(c_acctbal * 0.9 + case when c_custkey % 3 <> 0 then (c_custkey * 7919) % 1001 - 400 else 0 end, 2) as c_acctbal,
 case when c_custkey % 10 = 0 then 'BUILDING' else c_mktsegment end as c_mktsegment from customer) """

SCALED = PAIR.rstrip() + """, sc as (select min(c_nationkey) as a0, max(c_nationkey) - min(c_nationkey) as s0, min(c_acctbal) as a1,
 max(c_acctbal) - min(c_acctbal) as s1 from real),
 r as (select c_custkey as id, (c_nationkey - a0) / s0::double as x, (c_acctbal - a1) / s1 as y from real, sc),
 s as (select c_custkey as id, (c_nationkey - a0) / s0::double as x, (c_acctbal - a1) / s1 as y from syn, sc),
 rs as (select r.id, s.id as other, sqrt((r.x - s.x) ** 2 + (r.y - s.y) ** 2) as d from r, s),
 rr as (select r.id, t.id as other, sqrt((r.x - t.x) ** 2 + (r.y - t.y) ** 2) as d from r, r t where r.id <> t.id),
 ss as (select s.id, t.id as other, sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2) as d from s, s t where s.id <> t.id) """


# survival


LIFE = """with li as (select date_diff('day', o_orderdate, l_shipdate) as days, l_returnflag = 'R' as returned, l_linestatus
 from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate) """


def lifetimes(spark, folder):
    joined = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.where("l_shipdate >= o_orderdate").select(
        F.datediff("l_shipdate", "o_orderdate").alias("days"), (F.col("l_returnflag") == "R").alias("returned"), "l_linestatus"
    )


KM_SQL = """g as (select {by} days as time, count(*) filter (returned) as events, count(*) filter (not returned) as censored,
 count(*) as n from li group by all), k as (select *, sum(n) over ({part} order by time rows between current row and unbounded following)
 as at_risk from g), f as (select *, product(1 - events / at_risk::double) over ({part} order by time rows unbounded preceding) as s from k)
 select {by} time, cast(at_risk as bigint) as at_risk, events, censored, round(s, 6) as survival from f"""


@query("kaplan_meier_lineitem", LIFE + ", " + KM_SQL.format(by="", part=""))
def _(spark, folder):
    found = survival.kaplan_meier(lifetimes(spark, folder), "days", F.col("returned"))
    return found.withColumn("survival", rounded("survival", 6))


@query(
    "kaplan_meier_by_status_lineitem",
    LIFE + ", " + KM_SQL.format(by="l_linestatus,", part="partition by l_linestatus"),
)
def _(spark, folder):
    found = survival.kaplan_meier(lifetimes(spark, folder), "days", F.col("returned"), ["l_linestatus"])
    return found.withColumn("survival", rounded("survival", 6))


@query(
    "survival_curve_distance_lineitem",
    LIFE + """, g as (select days as time, count(*) filter (returned and l_linestatus = 'O') as d1, count(*) filter (l_linestatus = 'O') as n1,
 count(*) filter (returned and l_linestatus = 'F') as d2, count(*) filter (l_linestatus = 'F') as n2 from li group by 1),
 k as (select *, sum(n1) over w as r1, sum(n2) over w as r2, lead(time) over (order by time) as nxt from g
 window w as (order by time rows between current row and unbounded following)),
 f as (select time, nxt, product(case when d1 = 0 then 1 else 1 - d1 / r1::double end) over v as s1,
 product(case when d2 = 0 then 1 else 1 - d2 / r2::double end) over v as s2 from k window v as (order by time rows unbounded preceding))
 select round(sum(abs(s1 - s2) * coalesce(nxt - time, 0)), 4) as survival_km_distance from f""",
)
def _(spark, folder):
    life = lifetimes(spark, folder)
    found = metrics.survival_km_distance(
        life.where("l_linestatus = 'O'"), life.where("l_linestatus = 'F'"), "days", F.col("returned")
    )
    return found.select(rounded("survival_km_distance", 4))


# neighbours and valuation


@query(
    "nearest_neighbours_embeddings",
    """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
 p as (select a.vec_id as query_id, b.vec_id as base_id, list_distance(a.v, b.v) as d from e a, e b where a.vec_id <> b.vec_id),
 r as (select *, cast(row_number() over (partition by query_id order by d, base_id) as integer) as rank from p)
 select query_id, base_id, rank, round(d, 6) as distance from r where rank <= 5""",
)
def _(spark, folder):
    vectors = table(spark, folder, "embeddings")
    found = neighbours.knn(vectors, vectors, 5, "vec_id", "embedding", skip_same_id=True)
    return found.select("query_id", "base_id", "rank", rounded("distance", 6))


@query(
    "probed_neighbours_embeddings",
    """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
 p as (select a.vec_id as query_id, b.vec_id as base_id, list_distance(a.v, b.v) as d from e a, e b where a.vec_id <> b.vec_id),
 r as (select *, cast(row_number() over (partition by query_id order by d, base_id) as integer) as rank from p)
 select query_id, base_id, rank, round(d, 6) as distance, true as certain from r where rank <= 3""",
)
def _(spark, folder):
    """With every cell among the probes the search is certain of all its rows."""
    vectors = table(spark, folder, "embeddings")
    found = neighbours.knn_probed(vectors, vectors, 3, neighbours.MOST_PIVOTS, "vec_id", "embedding", skip_same_id=True)
    return found.select("query_id", "base_id", "rank", rounded("distance", 6), "certain")


@query(
    "iqr_outlier_rows_part",
    """with p as (select *, (p_partkey % 97) * (p_partkey % 97) as x from part), b as (select quantile_cont(x, 0.25) as a,
 quantile_cont(x, 0.75) as b, quantile_cont(p_retailprice, 0.25) as c, quantile_cont(p_retailprice, 0.75) as d from p)
 select p_partkey, x, (x < a - 1.75 * (b - a) or x > b + 1.75 * (b - a) or p_retailprice < c - 1.75 * (d - c)
 or p_retailprice > d + 1.75 * (d - c)) as is_outlier from p, b""",
)
def _(spark, folder):
    part = table(spark, folder, "part").withColumn("x", (F.col("p_partkey") % 97) * (F.col("p_partkey") % 97))
    clean, outliers = valuation.iqr_outliers(part, ["x", "p_retailprice"])
    return clean.withColumn("is_outlier", F.lit(False)).unionByName(outliers.withColumn("is_outlier", F.lit(True))).select(
        "p_partkey", "x", "is_outlier"
    )


@query(
    "knn_outlier_rows_embeddings",
    """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
 p as (select a.vec_id, list_distance(a.v, b.v) as d, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id)
 as rn from e a, e b where a.vec_id <> b.vec_id), k as (select vec_id, d from p where rn = 5)
 select vec_id from k where d > (select quantile_cont(d, 0.95) from k)""",
)
def _(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return valuation.knn_outliers(vectors, 0.05, 5, "vec_id", "embedding")[1].select("vec_id")


def embedding_split(spark, folder):
    """Every fifth vector is a test row, the others train."""
    vectors = table(spark, folder, "embeddings")
    return vectors.where("vec_id % 5 <> 0"), vectors.where("vec_id % 5 = 0")


SHAPLEY = """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
 p as (select t.vec_id as test_id, a.vec_id as id, (a.label = t.label)::int as m,
 row_number() over (partition by t.vec_id order by list_distance(a.v, t.v), a.vec_id) as r
 from e a, e t where a.vec_id % 5 <> 0 and t.vec_id % 5 = 0), """


@query(
    "knn_shapley_embeddings",
    SHAPLEY + """n as (select count(*) as c from e where vec_id % 5 <> 0),
 d as (select test_id, id, r, case when r = c then m / c::double * least(10, c) / 10 else
 (m - lead(m) over (partition by test_id order by r)) / 10.0::double * least(10, r) / r end as step from p, n),
 s as (select id, sum(step) over (partition by test_id order by r desc rows unbounded preceding) as v from d)
 select id, round(avg(v), 6) as value from s group by id""",
)
def _(spark, folder):
    train, test = embedding_split(spark, folder)
    found = valuation.knn_shapley(train, test, 10, "vec_id", "embedding", "label")
    return found.select("id", rounded("value", 6))


@query(
    "knn_shapley_within_embeddings",
    SHAPLEY + """d as (select test_id, id, r, case when r >= 50 then 0 else
 (m - lead(m) over (partition by test_id order by r)) / 10.0::double * least(10, r) / r end as step from p),
 s as (select id, test_id, sum(step) over (partition by test_id order by r desc rows unbounded preceding) as v from d)
 select id, round(sum(v) / count(distinct test_id), 6) as value from s group by id""",
)
def _(spark, folder):
    train, test = embedding_split(spark, folder)
    found = valuation.knn_shapley_within(train, test, 10, 0.02, "vec_id", "embedding", "label")
    return found.select("id", rounded("value", 6))


# scores: sanity


@query("data_mismatch_customer", "select round(2 / 5, 6) as data_mismatch")
def _(spark, folder):
    real, syn = customer_pair(spark, folder)
    other = syn.withColumn("c_custkey", F.col("c_custkey").cast("string")).drop("c_name")
    return metrics.data_mismatch(real, other).select(rounded("data_mismatch", 6))


@query(
    "common_rows_customer",
    PAIR + """select round(count(*) filter ((c_nationkey, c_mktsegment) in (select (c_nationkey, c_mktsegment) from syn
 where c_acctbal > 0)) / count(*), 6) as common_rows_proportion from real""",
)
def _(spark, folder):
    real, syn = customer_pair(spark, folder)
    columns = ["c_nationkey", "c_mktsegment"]
    found = metrics.common_rows(real.select(*columns), syn.where("c_acctbal > 0").select(*columns))
    return found.select(rounded("common_rows_proportion", 6))


@query(
    "neighbour_sanity_customer",
    SCALED + """select round(avg(d), 6) as nearest_syn_neighbor_distance, round(avg((d <= 0.2)::int), 6) as close_values_probability,
 round(avg((d >= 0.8)::int), 6) as distant_values_probability from (select min(d) as d from rs group by id)""",
)
def _(spark, folder):
    found = metrics.neighbour_sanity(*customer_pair(spark, folder), SYN_COLUMNS, "c_custkey")
    return found.select(*[rounded(c, 6) for c in found.columns])


# scores: fidelity


def bins_sql(c: str, numeric: bool) -> str:
    if not numeric:
        return f"select '{c}' as col, {c} as bin, count(*) filter (r = 1) as a, count(*) filter (r = 0) as b from u group by 2"
    return f"""select '{c}' as col, cast(least(floor(({c} - lo) / (w / 10.0::double)), 9) as varchar) as bin, count(*) filter (r = 1) as a,
 count(*) filter (r = 0) as b from u, (select min({c})::double as lo, max({c})::double - min({c})::double as w from u) group by 2"""


@query(
    "histogram_distances_customer",
    PAIR.rstrip() + ", u as (select 1 as r, * from real union all select 0, * from syn), h as ("
    + " union all ".join([bins_sql("c_acctbal", True), bins_sql("c_nationkey", True), bins_sql("c_mktsegment", False)])
    + """), t as (select *, sum(a) over (partition by col) as ta, sum(b) over (partition by col) as tb, count(*) over (partition by col) as k from h),
 p as (select *, a / ta::double as p, b / tb::double as s, (a + 1) / (ta + k)::double as p1, (b + 1) / (tb + k)::double as s1,
 (a + b) * ta / (ta + tb)::double as ea, (a + b) * tb / (ta + tb)::double as eb from t)
 select col as "column", round(sqrt(greatest(sum(case when p > 0 then p * log2(2 * p / (p + s)) else 0 end
 + case when s > 0 then s * log2(2 * s / (p + s)) else 0 end) / 2, 0)), 6) as jensenshannon_dist,
 round(1 / (1 + sum(p1 * ln(p1 / s1))), 6) as inv_kl_divergence,
 round(sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb), 4) as chi_squared, count(*) - 1 as freedom from p group by col""",
)
def _(spark, folder):
    real, syn = customer_pair(spark, folder)
    found = metrics.histogram_distances(real, syn, ["c_acctbal", "c_nationkey", "c_mktsegment"])
    return found.select(
        "column", rounded("jensenshannon_dist", 6), rounded("inv_kl_divergence", 6), rounded("chi_squared", 4), "freedom"
    )


@query(
    "distribution_distances_customer",
    PAIR + each(
        """select '{c}' as "column", round(1 - max(g), 6) as ks_test, round(sum(g * coalesce(nxt - v, 0) / w), 6) as wasserstein_dist from (
 select v, lead(v) over (order by v) as nxt, abs(sum(a) over (order by v) / sum(a) over ()::double - sum(b) over (order by v) / sum(b) over ()::double) as g
 from (select {c}::double as v, count(*) filter (r = 1) as a, count(*) filter (r = 0) as b from (select 1 as r, * from real union all
 select 0, * from syn) group by 1)), (select (max({c}) - min({c}))::double as w from real)""",
        SYN_COLUMNS,
    ).replace("sum(a) over ()::double", "cast(sum(a) over () as double)").replace("sum(b) over ()::double", "cast(sum(b) over () as double)"),
)
def _(spark, folder):
    found = metrics.distribution_distances(*customer_pair(spark, folder), SYN_COLUMNS)
    return found.select("column", rounded("ks_test", 6), rounded("wasserstein_dist", 6))


@query(
    "correlation_distance_customer",
    PAIR + """, a as (select corr(c_custkey, c_nationkey) as x, corr(c_custkey, c_acctbal) as y, corr(c_nationkey, c_acctbal) as z from real),
 b as (select corr(c_custkey, c_nationkey) as x, corr(c_custkey, c_acctbal) as y, corr(c_nationkey, c_acctbal) as z from syn)
 select round(sqrt(2 * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) as feature_corr from a, b""",
)
def _(spark, folder):
    found = metrics.correlation_distance(*customer_pair(spark, folder), ["c_custkey", "c_nationkey", "c_acctbal"])
    return found.select(rounded("feature_corr", 6))


@query("mean_discrepancy_customer")
def _(spark, folder):
    found = metrics.mean_discrepancy(*customer_pair(spark, folder), SYN_COLUMNS)
    return found.select(rounded("max_mean_discrepancy", 6))


@query(
    "prdc_customer",
    SCALED + """, kr as (select id, d as radius from (select *, row_number() over (partition by id order by d, other) as rn from rr) where rn = 5),
 ks as (select id, d as radius from (select *, row_number() over (partition by id order by d, other) as rn from ss) where rn = 5),
 n as (select count(*) as n from customer)
 select round((select count(distinct other) from rs join kr on rs.id = kr.id where d <= radius) / n, 6) as precision,
 round((select count(*) from rs join kr on rs.id = kr.id where d <= radius) / n / 5, 6) as density,
 round((select count(distinct rs.id) from rs join ks on rs.other = ks.id where d <= radius) / n, 6) as recall,
 round((select avg((d <= radius)::int) from (select id, min(d) as d from rs group by id) join kr using (id)), 6) as coverage from n""",
)
def _(spark, folder):
    found = metrics.prdc(*customer_pair(spark, folder), SYN_COLUMNS, "c_custkey")
    return found.select(*[rounded(c, 6) for c in ("precision", "density", "recall", "coverage")])


def coverage_sql(inner: str, outer: str) -> str:
    levels = [(i + 1) / 20 for i in range(20)]
    gaps = " + ".join(f"abs((select avg((d <= (select quantile_cont(d, {a}) from i{inner}))::int) from o{inner}) - {a})" for a in levels)
    return f"round(1 - 2 * ({gaps}) / 20, 6)"


@query(
    "alpha_precision_customer",
    SCALED + """, ir as (select sqrt((x - mx) ** 2 + (y - my) ** 2) as d from r, (select avg(x) as mx, avg(y) as my from r)),
 "or" as (select sqrt((x - mx) ** 2 + (y - my) ** 2) as d from s, (select avg(x) as mx, avg(y) as my from r)),
 "is" as (select sqrt((x - mx) ** 2 + (y - my) ** 2) as d from s, (select avg(x) as mx, avg(y) as my from s)),
 os as (select sqrt((x - mx) ** 2 + (y - my) ** 2) as d from r, (select avg(x) as mx, avg(y) as my from s)),
 nr as (select other as syn_id, arg_min(id, (d, id)) as real_id, min(d) as d from rs group by 1),
 ow as (select id, min(d) as own from rr group by 1)
 select """ + coverage_sql("r", "s").replace("from or)", 'from "or")') + " as alpha_precision, "
    + coverage_sql("s", "r").replace("from is)", 'from "is")')
    + """ as beta_recall, round((select avg((d > own)::int) from nr join ow on nr.real_id = ow.id), 6) as authenticity""",
)
def _(spark, folder):
    found = metrics.alpha_precision(*customer_pair(spark, folder), SYN_COLUMNS, "c_custkey")
    return found.select(*[rounded(c, 6) for c in found.columns])


# scores: privacy


QUASI = ["c_nationkey", "c_acctbal"]
CLASS = "least(floor((c_acctbal - a1) / (s1 / 10.0::double)), 9)"
NATION = "least(floor((c_nationkey - a0) / (s0 / 10.0::double)), 9)"
SCALE_OF = """(select min(c_nationkey)::double as a0, (max(c_nationkey) - min(c_nationkey))::double as s0, min(c_acctbal) as a1,
 max(c_acctbal) - min(c_acctbal) as s1 from {t})"""


@query(
    "class_privacy_customer",
    PAIR + f"""select min(n) as k_anonymity, min(l) as distinct_l_diversity from (select count(*) as n, count(distinct c_mktsegment) as l
 from syn, {SCALE_OF.format(t='syn')} group by {CLASS}, {NATION})""",
)
def _(spark, folder):
    return metrics.class_privacy(customer_pair(spark, folder)[1], QUASI, "c_mktsegment")


@query(
    "linkage_privacy_customer",
    PAIR + f""", a as (select {CLASS} as x, {NATION} as y, count(*) as n from real, {SCALE_OF.format(t='real')} group by 1, 2),
 b as (select {CLASS} as x, {NATION} as y, count(*) as n from syn, {SCALE_OF.format(t='real')} group by 1, 2)
 select round(max(b.n / a.n), 6) as delta_presence, min(a.n) as k_map from a join b on a.x = b.x and a.y = b.y""",
)
def _(spark, folder):
    found = metrics.linkage_privacy(*customer_pair(spark, folder), QUASI)
    return found.select(rounded("delta_presence", 6), "k_map")


@query(
    "identifiability_customer",
    SCALED + """select round(avg((o.d < w.d)::int), 6) as identifiability_score from (select id, min(d) as d from rs group by id) o
 join (select id, min(d) as d from rr group by id) w using (id)""",
)
def _(spark, folder):
    found = metrics.identifiability(*customer_pair(spark, folder), SYN_COLUMNS, "c_custkey")
    return found.select(rounded("identifiability_score", 6))


@query(
    "score_table_orders",
    """with s as (select case when o_orderstatus = 'F' then 'gt' else 'generator ' || o_orderstatus end as generator,
 o_orderkey % 3 as repeat, 'stats' as family, 'mean total' as metric, avg(o_totalprice) as value from orders group by all),
 t as (select generator, family, metric, avg(value) as mean, stddev_samp(value) as std, min(value) as min, max(value) as max,
 count(value) as repeats from s group by all)
 select a.generator, a.family, a.metric, round(a.mean, 4) as mean, round(a.std, 4) as std, round(a.min, 4) as min,
 round(a.max, 4) as max, a.repeats, round(g.mean, 4) as gt from t a join t g on g.generator = 'gt' and g.metric = a.metric
 where a.generator <> 'gt'""",
)
def _(spark, folder):
    generator = F.when(F.col("o_orderstatus") == "F", "gt").otherwise(F.concat(F.lit("generator "), "o_orderstatus"))
    scores = table(spark, folder, "orders").groupBy(
        generator.alias("generator"), (F.col("o_orderkey") % 3).alias("repeat"), F.lit("stats").alias("family"), F.lit("mean total").alias("metric")
    ).agg(F.avg("o_totalprice").alias("value"))
    found = metrics.with_ground_truth(metrics.score_table(scores))
    return found.select(
        "generator", "family", "metric", *[rounded(c, 4) for c in ("mean", "std", "min", "max")], "repeats", rounded("gt", 4)
    )


@query("score_report_customer")
def _(spark, folder):
    real, syn = customer_pair(spark, folder)
    found = metrics.evaluate(real.drop("c_name"), syn.drop("c_name"), "c_custkey", quasi=QUASI, sensitive="c_mktsegment")
    return found.withColumn("value", rounded("value", 6))
