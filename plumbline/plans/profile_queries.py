"""Queries over the profile and descriptive-table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.probit import density_sql, probit_sql
from plumbline.operators import profile, table1
from plumbline.operators.common import constants
from plumbline.plans.registry import query, rounded, table

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ALL = LINE_NUMBERS[:8] + ["l_returnflag", "l_linestatus", "l_shipdate"]


def lineitem_with_gaps(spark, folder):
    """``lineitem`` whose zero discounts and ``N`` flags are missing."""
    return (
        table(spark, folder, "lineitem")
        .withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
        .withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
    )


GAPS = """with li as (select * replace (nullif(l_discount, 0.0) as l_discount, nullif(l_returnflag, 'N') as l_returnflag)
 from lineitem) """


def each(template: str, columns, join=" union all ") -> str:
    """One SELECT per column: ``{c}`` is the column, ``{i}`` its position."""
    return join.join(template.format(c=c, i=i) for i, c in enumerate(columns))


@query("shape_orders", "select count(*) as rows, 6 as columns from orders")
def _(spark, folder):
    return profile.shape(table(spark, folder, "orders"))


@query(
    "column_types_lineitem",
    """select cast(row_number() over (order by column_index) - 1 as integer) as position, column_name as "column",
 case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double'
 when 'VARCHAR' then 'string' else 'timestamp_ntz' end as type
 from duckdb_columns() where table_name = 'lineitem' order by 1""",
)
def _(spark, folder):
    return profile.column_types(table(spark, folder, "lineitem"))


DESCRIBE_SQL = each(
    """select '{c}' as "column", cast(count({c}) as double) as count, round(avg({c}), 4) as mean,
 round(stddev_samp({c}), 4) as std, round(min({c}), 4) as min, round(quantile_cont({c}::double, 0.25), 4) as q25,
 round(quantile_cont({c}::double, 0.5), 4) as q50, round(quantile_cont({c}::double, 0.75), 4) as q75,
 round(max({c}), 4) as max, round(skewness({c}), 4) as skew, round(kurtosis({c}), 4) as kurt from li""",
    LINE_NUMBERS,
)


@query("numeric_describe_lineitem", GAPS + DESCRIBE_SQL)
def numeric_describe(spark, folder):
    stats = profile.describe(lineitem_with_gaps(spark, folder))
    numbers = ["mean", "std", "min", "q25", "q50", "q75", "max", "skew", "kurt"]
    return stats.select("column", "count", *[rounded(n, 4) for n in numbers])


@query(
    "numeric_but_categorical_lineitem",
    each(
        """select '{c}' as "column", bool_and({c} = floor({c})) as all_integral, count(distinct {c}) as nunique,
 count(*) as rows, bool_and({c} = floor({c})) and count(distinct {c}) <= least(20, 0.05 * count(*)) as is_categorical
 from lineitem""",
        LINE_NUMBERS,
    ),
)
def _(spark, folder):
    return profile.category_check(table(spark, folder, "lineitem"))


@query(
    "detected_category_values_lineitem",
    each(
        """select '{c}' as "column", v as value, cast(row_number() over (order by v) - 1 as integer) as code from
 (select distinct cast({c} as double) as v from lineitem) where (select bool_and({c} = floor({c}))
 and count(distinct {c}) <= least(20, 0.05 * count(*)) from lineitem)""",
        LINE_NUMBERS,
    ),
)
def _(spark, folder):
    df = table(spark, folder, "lineitem")
    found = profile.detect_categoricals(df)
    rows = [(c, float(v), code) for c, values in found.items() for code, v in enumerate(values)]
    return constants(df, rows, ["column", "value", "code"], ["string", "double", "int"])


@query(
    "distinct_counts_lineitem",
    GAPS + each("""select '{c}' as "column", count(distinct {c}) as nunique from li""", LINE_ALL),
)
def _(spark, folder):
    return profile.distinct_counts(lineitem_with_gaps(spark, folder))


CATEGORY_COLUMNS = ["p_brand", "p_type", "p_name"]
PART_COUNTS = (
    "with c as ("
    + each("""select '{c}' as "column", {c} as value, count(*) as n from part where {c} is not null group by {c}""", CATEGORY_COLUMNS)
    + ") "
)


@query(
    "top_values_part",
    PART_COUNTS + """select * from (select "column", value, n,
 cast(row_number() over (partition by "column" order by n desc, value) as integer) as rank from c) where rank <= 5""",
)
def _(spark, folder):
    return profile.ranked_values(table(spark, folder, "part"), CATEGORY_COLUMNS)


@query(
    "rare_values_part",
    PART_COUNTS + """select * from (select "column", value, n,
 cast(row_number() over (partition by "column" order by n, value desc) as integer) as rank_from_end from c)
 where rank_from_end <= 5 and "column" in (select "column" from c group by 1 having count(*) > 5)""",
)
def _(spark, folder):
    return profile.rare_values(table(spark, folder, "part"), CATEGORY_COLUMNS)


@query(
    "missing_counts_lineitem",
    GAPS + "select * from ("
    + each(
        """select '{c}' as "column", count(*) - count({c}) as missing, count(*) as rows,
 round((count(*) - count({c})) * 100.0 / count(*), 6) as pct from li""",
        LINE_ALL,
    )
    + ") where missing > 0",
)
def _(spark, folder):
    found = profile.missing_counts(lineitem_with_gaps(spark, folder))
    return found.select("column", "missing", "rows", rounded("pct", 6))


@query(
    "missing_rows_lineitem",
    GAPS + """select count(*) as rows, count(*) filter (l_discount is null or l_returnflag is null) as rows_any_missing,
 round(count(*) filter (l_discount is null or l_returnflag is null) * 100.0 / count(*), 6) as pct_any_missing,
 cast(0 as bigint) as rows_all_missing, 0 as columns_all_missing from li""",
)
def _(spark, folder):
    found = profile.missing_rows(lineitem_with_gaps(spark, folder))
    return found.withColumn("pct_any_missing", rounded("pct_any_missing", 6))


@query(
    "empty_columns_orders",
    """with o as (select *, case when o_totalprice < 0 then o_orderpriority end as no_value from orders)
 select 'no_value' as "column", count(*) as rows from o having count(no_value) = 0""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    return profile.empty_columns(orders.withColumn("no_value", F.when(F.col("o_totalprice") < 0, F.col("o_orderpriority"))))


@query(
    "category_codes_lineitem",
    """select code, count(*) as n, sum(l_linenumber) as total from (select l_linenumber,
 cast(dense_rank() over (order by l_linenumber) - 1 as integer) as code from lineitem) group by code""",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem")
    coded = profile.encode_categories(
        df.withColumn("code", F.col("l_linenumber")), {"code": profile.detect_categoricals(df)["l_linenumber"]}
    )
    return coded.groupBy("code").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))


PAIRS = [(i, a, j, b) for i, a in enumerate(LINE_NUMBERS) for j, b in enumerate(LINE_NUMBERS) if i < j]
CORR_SQL = " union all ".join(
    f"""select {i} as i, {j} as j, '{a}' as feature_1, '{b}' as feature_2, corr({a}, {b}) as r from li"""
    for i, a, j, b in PAIRS
)


@query(
    "correlation_matrix_lineitem",
    GAPS + f"select i, j, feature_1, feature_2, round(r, 6) as r from ({CORR_SQL})",
)
def _(spark, folder):
    found = profile.correlations(lineitem_with_gaps(spark, folder))
    return found.withColumn("r", rounded("r", 6))


@query(
    "top_correlated_pairs_lineitem",
    GAPS + f""", c as ({CORR_SQL}) select sign, rank, feature_1, feature_2, round(r, 6) as r from (
 select *, cast(row_number() over (partition by sign order by abs(r) desc, i, j) as integer) as rank from (
 select *, case when r > 0 then 'positive' else 'negative' end as sign from c where r <> 0)) where rank <= 10""",
)
def _(spark, folder):
    found = profile.top_correlations(lineitem_with_gaps(spark, folder))
    return found.withColumn("r", rounded("r", 6))


@query(
    "correlogram_lineitem",
    GAPS + f""", c as ({CORR_SQL}), best as (select abs(r) as m, min({{'i': i, 'j': j, 'a': feature_1, 'b': feature_2}}) as p
 from c where abs(r) < 1 group by 1 order by 1 desc limit 3),
 f as (select p.a as f from best union select p.b from best union select 'l_tax')
 select feature_1, feature_2, round(r, 6) as r from c where feature_1 in (from f) and feature_2 in (from f)""",
)
def _(spark, folder):
    found = profile.correlogram(lineitem_with_gaps(spark, folder), target="l_tax", n=3)
    return found.withColumn("r", rounded("r", 6))


@query(
    "iqr_outliers_lineitem",
    GAPS + each(
        """select '{c}' as "column", round(any_value(lo), 4) as lower, round(any_value(hi), 4) as upper,
 count(*) filter ({c} < lo or {c} > hi) as outliers from li,
 (select b - 1.75 * (d - b) as lo, d + 1.75 * (d - b) as hi from (select quantile_cont({c}::double, 0.25) as b,
 quantile_cont({c}::double, 0.75) as d from li))""",
        LINE_NUMBERS,
    ),
)
def _(spark, folder):
    found = profile.outlier_counts(lineitem_with_gaps(spark, folder))
    return found.select("column", rounded("lower", 4), rounded("upper", 4), "outliers")


@query(
    "duplicate_rows_orders",
    """select cast(sum(n) as bigint) as rows, cast(sum(n - 1) as bigint) as duplicates from (select count(*) as n
 from orders group by o_custkey, o_orderstatus, o_orderpriority)""",
)
def _(spark, folder):
    return profile.duplicate_rows(table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query(
    "class_distribution_customer",
    """select c_mktsegment as class, count(*) as n, round(count(*) / (select count(*) from customer), 6) as share
 from customer group by 1""",
)
def _(spark, folder):
    found = profile.class_distribution(table(spark, folder, "customer"), "c_mktsegment")
    return found.withColumn("share", rounded("share", 6))


@query(
    "full_report_customer",
    """with n as (select * from customer), num as ("""
    + each(
        """select '{c}' as "column", count({c})::double as count, avg({c}) as mean, stddev_samp({c}) as std,
 min({c})::double as min, quantile_cont({c}::double, 0.25) as q25, quantile_cont({c}::double, 0.5) as q50,
 quantile_cont({c}::double, 0.75) as q75, max({c})::double as max, skewness({c}) as skew, kurtosis({c}) as kurt from n""",
        ["c_custkey", "c_nationkey", "c_acctbal"],
    )
    + """) select 'numeric' as section, "column", stat, round(value, 4) as value from num
 unpivot (value for stat in (count, mean, std, min, q25, q50, q75, max, skew, kurt))
 union all select 'shape', '*', 'rows', count(*) from customer union all select 'shape', '*', 'columns', 5
 union all select 'duplicates', '*', 'duplicates', 0
 union all select 'distinct', 'c_mktsegment', 'nunique', count(distinct c_mktsegment) from customer
 union all select 'distinct', 'c_name', 'nunique', count(distinct c_name) from customer
 union all select 'target', 'c_mktsegment', c_mktsegment, count(*) from customer group by c_mktsegment
 union all select * from (select 'top_values', 'c_mktsegment', c_mktsegment, count(*) from customer
  group by c_mktsegment order by 4 desc, 3 limit 5)""",
)
def _(spark, folder):
    found = profile.report(table(spark, folder, "customer"), target="c_mktsegment")
    sections = ["numeric", "shape", "duplicates", "distinct", "target", "top_values"]
    return found.where(
        F.col("section").isin(sections) & ~((F.col("section") == "top_values") & (F.col("column") == "c_name"))
    ).withColumn("value", rounded(F.col("value").cast("double"), 4))


def normality_sql(t: str, columns) -> str:
    """Shapiro-Francia from the collapsed values; ``columns`` maps names to expressions."""
    cells = " union all ".join(f"""select '{c}' as "column", cast({x} as double) as value from {t}""" for c, x in columns.items())
    return f"""with g as (select "column", value, count(*)::double as n from ({cells}) where value is not null group by all),
 r as (select *, sum(n) over (partition by "column" order by value) as cum, sum(n) over (partition by "column") as total,
   sum(n * value) over (partition by "column") / sum(n) over (partition by "column") as mean from g),
 e as (select *, total + 0.25 as size, (cum - n + 0.125) / (total + 0.25) as low, (cum + 0.125) / (total + 0.25) as high, (cum - 0.375) / (total + 0.25) as own from r),
 z as (select *, {probit_sql("low")} as a, {probit_sql("high")} as b, {probit_sql("own")} as m from e),
 f as (select *, {density_sql("a")} as fa, {density_sql("b")} as fb from z),
 w as (select "column", max(total) as n, sum(n * (value - mean) * (value - mean)) as xx, sum((value - mean) * case when n = 1 then m else (fa - fb) * size end) as xm,
   sum(case when n = 1 then m * m else (high - b * fb - low + a * fa) * size end) as mm from f group by "column"),
 v as (select "column", n, xm * xm / (xx * mm) as w, ln(n) as u from w)
 select "column", n::bigint as n, round(w, 8) as w, (ln(1 - w) - (-1.2725 + 1.0521 * (ln(u) - u))) / (1.0308 - 0.26758 * (ln(u) + 2 / u)) < 4.264890793922602 as is_normal from v"""


LINE_CONTINUOUS = ["l_extendedprice", "l_quantity", "l_tax", "l_partkey"]
COMPONENTS = ["e1", "e2", "e3", "e4"]


@query("normality_verdicts_lineitem", normality_sql("lineitem", {c: c for c in LINE_CONTINUOUS}))
def _(spark, folder):
    found = table1.normality(table(spark, folder, "lineitem"), LINE_CONTINUOUS)
    return found.select("column", "n", rounded("w", 8), "is_normal")


@query("normality_verdicts_embeddings", normality_sql("embeddings", {**{c: f"embedding[{c[1]}]" for c in COMPONENTS}, "cube": "embedding[1]::double * embedding[1]::double * embedding[1]::double"}))
def _(spark, folder):
    """Components that come close to a normal distribution, and the cube of one."""
    parts = table(spark, folder, "embeddings").select(*[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(COMPONENTS)])
    found = table1.normality(parts.withColumn("cube", F.col("e1") * F.col("e1") * F.col("e1")), [*COMPONENTS, "cube"])
    return found.select("column", "n", rounded("w", 8), "is_normal")


@query("sampled_normality_lineitem")
def _(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("line_key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return table1.sampled_normality(df, ["l_extendedprice", "l_quantity"], key="line_key")


def top_other_sql(t: str, columns) -> str:
    """Top five values, then everything else (nulls too) once there are more than five."""
    return each(
        f"""select * from (with v as (select {{c}} as value, count(*) as n, row_number() over (order by count(*) desc, {{c}}) as rn
 from {t} where {{c}} is not null group by 1)
 select '{{c}}' as "column", cast(value as varchar) as value, n, cast(rn as integer) as line from v where rn <= 5
 union all select '{{c}}', 'Other', (select count(*) from {t}) - cast((select sum(n) from v where rn <= 5) as bigint), 6
 from v having count(*) > 5)""",
        columns,
    )


GAP_PARTS = "with pt as (select * replace (nullif(p_brand, 'Brand#3') as p_brand) from part) "


def part_with_gaps(spark, folder):
    return table(spark, folder, "part").withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#3")))


@query("top_values_with_other_part", GAP_PARTS + top_other_sql("pt", ["p_brand", "p_type", "p_name"]))
def _(spark, folder):
    return table1.top_with_other(part_with_gaps(spark, folder), ["p_brand", "p_type", "p_name"])


def category_lines_sql(t: str, columns) -> str:
    return (
        "select '{0}' where false".format("") if not columns else
        "select \"column\", line, printf('<<%s>> %s', \"column\", value) as variable,"
        " printf('%d/%d (%.1f)', n, total, n / total * 100) as summary from ("
        + top_other_sql(t, columns)
        + ") join ("
        + each(f"""select '{{c}}' as "column", count({{c}}) as total from {t}""", columns)
        + """) using ("column") union all """
        + each("""select '{c}', 0, '{c}', ''""", columns)
    )


@query("category_lines_part", GAP_PARTS + category_lines_sql("pt", ["p_brand", "p_type"]))
def _(spark, folder):
    return table1.category_lines(part_with_gaps(spark, folder), ["p_brand", "p_type"])


@query(
    "three_figure_decimals_orders",
    """select o_orderkey, case when x = 0 then 0 else cast(greatest(2 - floor(log10(abs(x))), 0) as integer) end as decimals
 from (select o_orderkey, o_totalprice / (o_orderkey + 1) - 1.0 as x from orders)""",
)
def _(spark, folder):
    x = F.col("o_totalprice") / (F.col("o_orderkey") + 1) - 1.0
    return table(spark, folder, "orders").select("o_orderkey", table1.decimals_for_figures(x).alias("decimals"))


def decimals(x: str) -> str:
    return f"case when {x} = 0 then 0 else cast(greatest(2 - floor(log10(abs({x}))), 0) as integer) end"


def fixed_text(x: str, d: str) -> str:
    """DuckDB text with a variable number of decimals."""
    return f"printf('%.' || {d} || 'f', {x})"


@query(
    "normal_lines_lineitem",
    each(
        f"""select '{{c}}' as "column", 0 as line, '{{c}}' as variable,
 {fixed_text('m', 'd')} || ' ± ' || {fixed_text('s', 'd')} as summary from (select m, s, {decimals('m')} as d from (
 select avg({{c}})::double as m, stddev_samp({{c}}) as s from lineitem))""",
        ["l_quantity", "l_discount", "l_extendedprice"],
    ),
)
def _(spark, folder):
    return table1.numeric_lines(table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], [])


NON_NORMAL_LINE = f"""select '{{c}}' as "column", 0 as line, '{{c}}' as variable,
 {fixed_text('m', 'd')} || ' (' || {fixed_text('a', 'd')} || ' - ' || {fixed_text('b', 'd')} || ')' as summary
 from (select m, a, b, {decimals('m')} as d from (select quantile_cont({{c}}::double, 0.5) as m,
 quantile_cont({{c}}::double, 0.25) as a, quantile_cont({{c}}::double, 0.75) as b from {{t}}))"""


@query(
    "non_normal_lines_lineitem",
    each(NON_NORMAL_LINE.replace("{t}", "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]),
)
def _(spark, folder):
    return table1.numeric_lines(table(spark, folder, "lineitem"), [], ["l_quantity", "l_discount", "l_extendedprice"])


@query(
    "column_partition_part",
    """select * from (values ('p_brand', 'categorical'), ('p_name', 'categorical'), ('p_type', 'categorical'),
 ('p_partkey', 'numeric'), ('p_size', 'numeric'), ('p_retailprice', 'numeric')) t("column", kind)""",
)
def _(spark, folder):
    df = table(spark, folder, "part")
    categorical, numeric = table1.partition_columns(df)
    rows = [(c, "categorical") for c in categorical] + [(c, "numeric") for c in numeric]
    return constants(df, rows, ["column", "kind"], ["string", "string"])


@query(
    "table_one_part",
    "with b as (select "
    "position, line, variable, summary from ("
    + category_lines_sql("part", ["p_brand", "p_name", "p_type"])
    + " union all "
    + each(NON_NORMAL_LINE.replace("{t}", "part"), ["p_partkey", "p_size"])
    + f""" union all select 'p_retailprice', 0, 'p_retailprice', {fixed_text('m', 'd')} || ' ± ' || {fixed_text('s', 'd')}
 from (select m, s, {decimals('m')} as d from (select avg(p_retailprice) as m, stddev_samp(p_retailprice) as s from part))"""
    + """) join (values (0, 'p_partkey'), (1, 'p_name'), (2, 'p_brand'), (3, 'p_type'), (4, 'p_size'), (5, 'p_retailprice'))
 o(position, "column") using ("column"))
 select position, line, regexp_replace(variable, '<<.*?>>', '   ') as variable, summary from b""",
)
def _(spark, folder):
    return table1.for_print(table1.table_one(table(spark, folder, "part"), normal=["p_retailprice"]))


@query(
    "bar_data_part",
    each("""select '{c}' as "column", {c} as value, count(*) as n from part group by 2""", ["p_brand", "p_type"]),
)
def _(spark, folder):
    return table1.bar_data(table(spark, folder, "part"), ["p_brand", "p_type"])


@query(
    "histogram_data_customer",
    """with s as (select count(*) as n, min(c_acctbal) as lo, max(c_acctbal) as hi,
 quantile_cont(c_acctbal, 0.25) as a, quantile_cont(c_acctbal, 0.75) as b from customer),
 k as (select lo, hi, greatest(ceil(log2(n) + 1), ceil((hi - lo) / (2 * (b - a) / n ** (1.0 / 3)))) as bins from s),
 t as (select cast(least(floor((c_acctbal - lo) / ((hi - lo) / bins)), bins - 1) as bigint) as bin, lo, (hi - lo) / bins as w
 from customer, k)
 select 'c_acctbal' as "column", bin, round(lo + bin * w, 4) as lower, round(lo + (bin + 1) * w, 4) as upper, count(*) as n
 from t group by bin, lo, w""",
)
def _(spark, folder):
    found = table1.histogram_data(table(spark, folder, "customer"), ["c_acctbal"])
    return found.select("column", "bin", rounded("lower", 4), rounded("upper", 4), "n")


@query(
    "box_data_customer",
    """with s as (select quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.5) as median,
 quantile_cont(c_acctbal, 0.75) as q3 from customer)
 select 'c_acctbal' as "column", round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3,
 round(min(c_acctbal) filter (c_acctbal between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 4) as whisker_low,
 round(max(c_acctbal) filter (c_acctbal between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 4) as whisker_high,
 count(*) filter (c_acctbal not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as fliers
 from customer, s group by q1, median, q3""",
)
def _(spark, folder):
    found = table1.box_data(table(spark, folder, "customer"), ["c_acctbal"])
    names = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return found.select("column", *[rounded(n, 4) for n in names], "fliers")
