"""Queries over cleaning, merging, comparison, text, conversation and file operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import clean, convlog, diff, merge, text
from plumbline.plans.profile_queries import GAPS, LINE_ALL, each, lineitem_with_gaps
from plumbline.plans.registry import query, rounded, table
from plumbline.session import scratch_dir
from plumbline.sources import files


def fresh_path(spark, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# sources


@query("csv_scan_part", "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def _(spark, folder):
    path = fresh_path(spark, "part-csv")
    table(spark, folder, "part").write.csv(path, header=True)
    return files.read_csv(spark, path)


@query(
    "csv_missing_tokens_part",
    """select p_partkey, case when p_type <> 'SMALL' then p_type end as p_type,
 case when p_size % 5 <> 0 then p_size::double end as p_size from part""",
)
def _(spark, folder):
    path = fresh_path(spark, "part-gaps-csv")
    part = table(spark, folder, "part").select(
        "p_partkey",
        F.when(F.col("p_type") != "SMALL", F.col("p_type")).otherwise("n/a").alias("p_type"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string")).otherwise("NaN").alias("p_size"),
    )
    part.write.csv(path, header=True)
    return files.read_csv(spark, path)


@query(
    "separator_retry_supplier",
    "select ';' as separator, s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier",
)
def _(spark, folder):
    path = fresh_path(spark, "supplier-csv")
    table(spark, folder, "supplier").write.csv(path, header=True, sep=";")
    found, sep = files.read_any_separator(spark, path)
    return found.withColumn("separator", F.lit(sep))


@query(
    "multi_file_load_orders",
    """select o_orderstatus as part_name, count(*) as rows, round(sum(o_totalprice), 2) as total from orders group by 1""",
)
def _(spark, folder):
    base = fresh_path(spark, "orders-csv")
    orders = table(spark, folder, "orders")
    for status in ("F", "O", "P"):
        orders.where(F.col("o_orderstatus") == status).write.csv(f"{base}/{status}", header=True)
    loaded = files.read_many(spark, [f"{base}/{s}" for s in ("F", "O", "P")])
    return loaded.groupBy(F.col("o_orderstatus").alias("part_name")).agg(
        F.count("*").alias("rows"), rounded(F.sum("o_totalprice"), 2, "total")
    )


@query("stage_sink_customer", "select * from customer where c_acctbal > 0")
def _(spark, folder):
    path = fresh_path(spark, "customer") + ".parquet"
    filtered = table(spark, folder, "customer").where("c_acctbal > 0")
    return spark.read.parquet(files.save_stage(filtered, path, "filtered"))


@query("summary_sink_part", """select cast(p_partkey as varchar) as p_partkey, p_brand from part""")
def _(spark, folder):
    target = files.save_summary(table(spark, folder, "part").select("p_partkey", "p_brand"), fresh_path(spark, "part"))
    return spark.read.csv(target, header=True)


@query("preview_lineitem", "select * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice limit 5")
def _(spark, folder):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return files.preview(table(spark, folder, "lineitem"), order)


# cleaning


@query("keep_columns_orders", "select o_orderkey, o_totalprice from orders")
def _(spark, folder):
    return clean.keep_columns(table(spark, folder, "orders"), ["o_orderkey", "o_totalprice"])


@query("drop_columns_customer", "select * exclude (c_name, c_mktsegment) from customer")
def _(spark, folder):
    return clean.drop_columns(table(spark, folder, "customer"), ["c_name", "c_mktsegment"])


def split_orders(spark, folder):
    """A train and a test part of ``orders`` that differ in their columns."""
    orders = table(spark, folder, "orders")
    train = orders.where("o_orderkey % 4 <> 0").drop("o_orderpriority")
    test = orders.where("o_orderkey % 4 = 0").drop("o_custkey")
    return train, test


@query(
    "column_parity_orders",
    """select column_name as "column", case column_name when 'o_custkey' then 'train' when 'o_orderpriority' then 'test'
 else 'both' end as found_in from duckdb_columns() where table_name = 'orders'""",
)
def _(spark, folder):
    return clean.column_parity(*split_orders(spark, folder))


@query(
    "aligned_columns_orders",
    """select case when o_orderkey % 4 = 0 then 'test' else 'train' end as side, o_orderkey, o_orderstatus, o_totalprice,
 o_orderdate from orders""",
)
def _(spark, folder):
    train, test = clean.align_columns(*split_orders(spark, folder))
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query(
    "sentinels_to_null_lineitem",
    """select l_orderkey, l_linenumber, case when l_discount not in (0.0, 0.1) then l_discount end as l_discount,
 nullif(l_returnflag, 'N') as l_returnflag, l_quantity from lineitem""",
)
def _(spark, folder):
    columns = ["l_orderkey", "l_linenumber", "l_discount", "l_returnflag", "l_quantity"]
    lines = table(spark, folder, "lineitem").select(*columns)
    return clean.sentinels_to_null(lines, {"l_discount": [0.0, 0.1], "l_returnflag": ["N"]})


@query(
    "drop_high_missing_customer",
    """select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
 case when c_nationkey < 2 then c_nationkey end as kept_anyway from customer""",
)
def _(spark, folder):
    customer = table(spark, folder, "customer").withColumns(
        {
            "mostly_missing": F.when(F.col("c_acctbal") > 9900, F.col("c_acctbal")),
            "kept_anyway": F.when(F.col("c_nationkey") < 2, F.col("c_nationkey")),
        }
    )
    return clean.drop_high_missing(customer, keep=["kept_anyway"])[0]


@query(
    "missing_shares_lineitem",
    GAPS + each("""select '{c}' as "column", round((count(*) - count({c})) * 100.0 / count(*), 6) as pct from li""", LINE_ALL),
)
def _(spark, folder):
    found = clean.missing_shares(lineitem_with_gaps(spark, folder))
    return found.select("column", rounded("pct", 6))


@query("drop_missing_target_lineitem", GAPS + "select * from li where l_returnflag is not null")
def _(spark, folder):
    return clean.drop_missing_target(lineitem_with_gaps(spark, folder), "l_returnflag")


@query("drop_incomplete_rows_lineitem", GAPS + "select * from li where l_returnflag is not null and l_discount is not null")
def _(spark, folder):
    return clean.drop_incomplete_rows(lineitem_with_gaps(spark, folder))


@query("sample_size_check_nation", "select count(*) as rows, count(*) < 50 as too_small from nation")
def _(spark, folder):
    return clean.sample_size_check(table(spark, folder, "nation"))


@query(
    "type_suggestions_orders",
    """select * from (values ('key_text', 'bigint'), ('price_text', 'double'), ('date_text', 'timestamp_ntz'),
 ('o_orderstatus', 'string'), ('o_orderpriority', 'string')) t("column", suggested)""",
)
def _(spark, folder):
    return clean.type_suggestions(orders_as_text(spark, folder))


def orders_as_text(spark, folder):
    return table(spark, folder, "orders").select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("key_text"),
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date_text"),
        "o_orderstatus",
        "o_orderpriority",
    )


@query(
    "repaired_types_orders",
    """select o_orderkey as key_text, o_totalprice as price_text, o_orderdate as date_text, o_orderstatus, o_orderpriority
 from orders""",
)
def _(spark, folder):
    return clean.repair_types(orders_as_text(spark, folder))


@query(
    "durations_lineitem",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', o_orderdate, l_shipdate) as days,
 m + case when m > 0 and day(l_shipdate) < day(o_orderdate) then -1 when m < 0 and day(l_shipdate) > day(o_orderdate) then 1 else 0 end
 as months from (select *, (year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) as m from lineitem join orders on l_orderkey = o_orderkey)""",
)
def _(spark, folder):
    joined = table(spark, folder, "lineitem").join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        clean.duration(F.col("o_orderdate"), F.col("l_shipdate"), "DAY").alias("days"),
        clean.duration(F.col("o_orderdate"), F.col("l_shipdate"), "MONTH").alias("months"),
    )


@query(
    "subgroups_customer",
    """select 'in credit' as subgroup, c_custkey, c_acctbal from customer where c_acctbal > 0
 union all select 'building', c_custkey, c_acctbal from customer where c_mktsegment = 'BUILDING'""",
)
def _(spark, folder):
    groups = {"in credit": F.col("c_acctbal") > 0, "building": F.col("c_mktsegment") == "BUILDING"}
    found = clean.subgroups(table(spark, folder, "customer"), groups)
    return found.select("subgroup", "c_custkey", "c_acctbal")


@query("drop_flagged_ids_customer", "select * from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def _(spark, folder):
    flagged = table(spark, folder, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return clean.drop_ids(table(spark, folder, "customer"), flagged, "c_custkey")


@query(
    "drop_worst_share_orders",
    """with f as (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as rn, count(*) over () as n
 from orders where o_orderstatus = 'F')
 select * from orders where o_orderkey not in (select o_orderkey from f where rn <= ceil(0.1 * n))""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    return clean.drop_worst(orders, orders.where("o_orderstatus = 'F'"), "o_orderkey", "o_totalprice", 0.1)


@query(
    "identifier_columns_customer",
    """select "column", reason from (select 'c_custkey' as "column", 'all values distinct' as reason,
 count(distinct c_custkey) = count(c_custkey) as yes from customer union all
 select 'c_name', 'all values distinct', count(distinct c_name) = count(c_name) from customer union all
 select 'c_mktsegment', 'all values distinct', count(distinct c_mktsegment) = count(c_mktsegment) from customer union all
 select 'c_nationkey', 'all values distinct', count(distinct c_nationkey) = count(c_nationkey) from customer union all
 select 'same', 'constant', count(distinct c_acctbal * 0) = 1 from customer) where yes""",
)
def _(spark, folder):
    return clean.identifier_columns(table(spark, folder, "customer").withColumn("same", F.col("c_acctbal") * 0 + 1))


@query(
    "leakage_candidates_part",
    each(
        """select '{c}' as "column", 'correlation' as reason from part having abs(corr({c}, p_retailprice)) >= 0.95
 union all select '{c}', 'determines target' from (select count(*) as n, count(distinct p_retailprice) as k from
 (select *, p_retailprice * 2 + p_size / 1000 as nearly, p_partkey % 1000 as price_step from part) group by {c} having count(*) > 1)
 having min(k = 1)""".replace("from part having", "from (select *, p_retailprice * 2 + p_size / 1000 as nearly, p_partkey % 1000 as price_step from part) having"),
        ["p_partkey", "p_size", "nearly", "price_step"],
    )
    + " union all "
    + each(
        """select '{c}' as "column", 'determines target' as reason from (select count(*) as n, count(distinct p_retailprice) as k
 from part group by {c} having count(*) > 1) having min(k = 1)""",
        ["p_name", "p_brand", "p_type"],
    ),
)
def _(spark, folder):
    part = table(spark, folder, "part").withColumns(
        {"nearly": F.col("p_retailprice") * 2 + F.col("p_size") / 1000, "price_step": F.col("p_partkey") % 1000}
    )
    return clean.leakage_candidates(part, "p_retailprice")


# merging


@query(
    "merge_orders_customer",
    """select o_custkey, o_orderkey, o_totalprice, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return merge.merge(orders, customer, ["o_custkey"], {"c_custkey": "o_custkey"})


@query(
    "merge_report_orders_customer",
    """with o as (select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as o_orderstatus from orders),
 c as (select c_custkey as o_custkey, c_mktsegment from customer where c_acctbal > 0),
 m as (select * from o join c using (o_custkey)), s as (select (select count(*) from o) as big, (select count(*) from m) as merged)
 select 'o_custkey' as "column", big as rows_largest_input, merged as rows_merged, big - merged as rows_lost,
 cast(0 as bigint) as nulls_before, cast(0 as bigint) as nulls_after from s union all
 select 'o_orderkey', big, merged, big - merged, 0, 0 from s union all
 select 'c_mktsegment', big, merged, big - merged, 0, 0 from s union all
 select 'o_orderstatus', big, merged, big - merged, (select count(*) from o where o_orderstatus is null),
 (select count(*) from m where o_orderstatus is null) from s""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus")
    )
    customer = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return merge.merge_report([orders, customer], merge.merge(orders, customer, ["o_custkey"]))


@query(
    "key_uniqueness_lineitem",
    """select cast(sum(n) as bigint) as rows, count(*) as distinct_keys, max(n) as largest_group, max(n) <= 1 as is_unique
 from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)""",
)
def _(spark, folder):
    return merge.key_uniqueness(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "duplicated_keys_lineitem",
    "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
)
def _(spark, folder):
    return merge.duplicated_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def overlap_sql() -> str:
    """Exact Jaccard index of distinct values and edit-distance similarity of plain names."""
    left = {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_orderpriority": "s"}
    right = {"c_custkey": "n", "c_nationkey": "n", "c_mktsegment": "s"}
    parts = []
    for a, ka in left.items():
        for b, kb in right.items():
            if ka == kb:
                x, y = a.replace("_", ""), b.replace("_", "")
                parts.append(
                    f"""select '{a}' as left_column, '{b}' as right_column,
 1 - levenshtein('{x}', '{y}') / {max(len(x), len(y))}::double as name_score,
 (select count(*) from (select distinct {a}::varchar from orders intersect select distinct {b}::varchar from customer))::double /
 (select count(*) from (select {a}::varchar from orders union select {b}::varchar from customer)) as overlap"""
                )
    return (
        "select left_column, right_column, round(name_score, 6) as name_score, round(overlap, 6) as overlap,"
        " round((name_score + overlap) / 2, 6) as score from (" + " union all ".join(parts) + ")"
    )


@query("column_matches_orders_customer", overlap_sql())
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    found = merge.match_columns(orders, customer)
    return found.select("left_column", "right_column", rounded("name_score", 6), rounded("overlap", 6), rounded("score", 6))


# comparison of two versions


def part_versions(spark, folder):
    """``part`` before and after edits: rows gone, rows new, cells edited, gaps filled, a column renamed."""
    part = table(spark, folder, "part")
    before = part.where("p_partkey % 17 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")))
    after = (
        part.where("p_partkey % 19 <> 0")
        .withColumn("p_size", F.when((F.col("p_partkey") % 5 == 0) & (F.col("p_partkey") % 3 == 0), None).otherwise(F.col("p_size")))
        .withColumn("p_brand", F.when(F.col("p_partkey") % 7 == 0, F.lit("Brand#99")).otherwise(F.col("p_brand")))
        .withColumnRenamed("p_type", "p_kind")
    )
    return before, after


VERSIONS = """with b as (select * replace (case when p_partkey % 5 <> 0 then p_size end as p_size) from part where p_partkey % 17 <> 0),
 a as (select * replace (case when p_partkey % 15 = 0 then null else p_size end as p_size,
 case when p_partkey % 7 = 0 then 'Brand#99' else p_brand end as p_brand) from part where p_partkey % 19 <> 0),
 j as (select coalesce(b.p_partkey, a.p_partkey) as p_partkey, b.p_partkey is null as new, a.p_partkey is null as gone,
 b.p_name as n1, a.p_name as n2, b.p_brand as b1, a.p_brand as b2, b.p_size as s1, a.p_size as s2,
 b.p_retailprice as r1, a.p_retailprice as r2 from b full join a on a.p_partkey = b.p_partkey) """


@query(
    "column_changes_part",
    """select * from (values ('p_type', 'removed'), ('p_kind', 'added'), ('p_partkey', 'common'), ('p_name', 'common'),
 ('p_brand', 'common'), ('p_size', 'common'), ('p_retailprice', 'common')) t("column", change)""",
)
def _(spark, folder):
    return diff.column_changes(*part_versions(spark, folder))


@query(
    "exact_row_matches_part",
    VERSIONS.split(" j as ")[0].rstrip(", ") + """ select p_partkey, p_name, p_brand, p_size, p_retailprice from b
 intersect select p_partkey, p_name, p_brand, p_size, p_retailprice from a""",
)
def _(spark, folder):
    return diff.exact_matches(*part_versions(spark, folder))


@query(
    "imputed_rows_part",
    VERSIONS + """select p_partkey, cast(s1 is null and s2 is not null as integer) as filled from j where not new and not gone
 and n1 = n2 and b1 = b2 and r1 = r2 and (s1 is not distinct from s2 or s1 is null)""",
)
def _(spark, folder):
    return diff.imputed_rows(*part_versions(spark, folder), ["p_partkey"])


@query(
    "row_changes_part",
    VERSIONS + """select * from (select p_partkey, case when gone then 'removed' when new then 'added' else 'modified' end as change,
 case when not gone and not new then ((n1 = n2)::int + (b1 = b2)::int + (s1 is not distinct from s2)::int + (r1 = r2)::int) / 4 end
 as similarity from j) where change <> 'modified' or similarity < 1""",
)
def _(spark, folder):
    return diff.row_changes(*part_versions(spark, folder), ["p_partkey"])


@query(
    "cell_changes_part",
    VERSIONS + """, c as (select p_partkey, 'p_brand' as "column", b1 as before, b2 as after from j where not new and not gone and b1 <> b2
 union all select p_partkey, 'p_size', s1::varchar, s2::varchar from j where not new and not gone and s1 is distinct from s2)
 select *, coalesce(before, 'None') || ' → ' || coalesce(after, 'None') as text from c""",
)
def _(spark, folder):
    return diff.cell_changes(*part_versions(spark, folder), ["p_partkey"])


@query(
    "change_summary_part",
    VERSIONS + """select 'rows removed' as change, count(*) as n from j where gone union all
 select 'rows added', count(*) from j where new union all select 'rows modified', count(*) from j where not new and not gone
 and (b1 <> b2 or s1 is distinct from s2) union all select 'columns removed', 1 union all select 'columns added', 1
 union all select 'columns common', 5""",
)
def _(spark, folder):
    return diff.summary(*part_versions(spark, folder), ["p_partkey"])


def supplier_versions(spark, folder):
    """Two versions of a supplier table without a key: seven cells per row, some rows edited in one cell."""
    base = table(spark, folder, "supplier").select(
        "s_name", "s_nationkey", "s_acctbal", (F.col("s_suppkey") % 3).alias("a"), (F.col("s_suppkey") % 5).alias("b"),
        (F.col("s_suppkey") % 7).alias("c"), F.col("s_suppkey").alias("d"),
    )
    before = base.where("d % 11 <> 0")
    edited = F.when(F.col("d") % 4 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))
    after = base.where("d % 13 <> 0").withColumn("s_acctbal", edited)
    return before, after


KEYLESS = """with base as (select s_name, s_nationkey, s_acctbal, s_suppkey % 3 as a, s_suppkey % 5 as b, s_suppkey % 7 as c,
 s_suppkey as d from supplier), x as (select distinct * from base where d % 11 <> 0), y as (select distinct * replace (
 case when d % 4 = 0 then s_acctbal + 1 else s_acctbal end as s_acctbal) from base where d % 13 <> 0),
 p as (select y.d as yd, x.d as xd, (x.s_name = y.s_name)::int + (x.s_nationkey = y.s_nationkey)::int +
 (x.s_acctbal = y.s_acctbal)::int + (x.a = y.a)::int + (x.b = y.b)::int + (x.c = y.c)::int + (x.d = y.d)::int as same,
 row_number() over (partition by y.d order by same desc, x.s_name) as rn from x, y),
 m as (select * from p where rn = 1 and same / 7 > 0.8) """


@query(
    "keyless_row_pairs_supplier",
    KEYLESS + "select yd, xd, 7 - same as different from m",
)
def _(spark, folder):
    pairs = diff.similar_rows(*supplier_versions(spark, folder))
    return pairs.select(F.col("a.d").alias("yd"), F.col("b.d").alias("xd"), "different")


@query(
    "keyless_diff_supplier",
    KEYLESS + """select 'modified' as change, yd as d, 's_acctbal' as "column" from m where same < 7 union all
 select 'removed', d, null from x where d not in (select xd from m) union all
 select 'added', d, null from y where d not in (select yd from m)""",
)
def _(spark, folder):
    found = diff.keyless_diff(*supplier_versions(spark, folder))
    return found.select("change", F.col("row.d").alias("d"), "column")


# text


TOPICS = {"text": {"money": ["price", "eur", "$"], "person": ["name", "mail", "@"], "law": ["licen", "copyright"]}}


@query(
    "topic_features_documents",
    "select doc_id, " + ", ".join(
        "case when " + " or ".join(f"contains(lower(text), '{s}')" for s in synonyms) + f" then 'yes' else 'no' end as text_{topic}"
        for topic, synonyms in TOPICS["text"].items()
    ) + " from documents",
)
def _(spark, folder):
    found = text.topic_features(table(spark, folder, "documents").select("doc_id", "text"), TOPICS)
    return found.drop("text")


@query("safe_names_orders", "select o_orderkey, regexp_replace(o_orderpriority, '[^.\\p{L}\\p{N}_]', '-', 'g') as name from orders")
def _(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", scalars.safe_name(F.col("o_orderpriority")).alias("name"))


@query(
    "replace_in_order_conversations",
    """select conv_id, turn, replace(replace(replace(text, 'la', 'lo'), 'lo', '1'), '.', '!') as text from conversations""",
)
def _(spark, folder):
    replaced = scalars.replace_all(F.col("text"), {"la": "lo", "lo": 1, ".": "!"})
    return table(spark, folder, "conversations").select("conv_id", "turn", replaced.alias("text"))


@query(
    "human_sizes_documents",
    """select doc_id, round(b / pow(1024.0, k), 6) as size, (['B', 'KB', 'MB', 'GB', 'TB', 'PB'])[k + 1] as unit from (
 select doc_id, b, least(5, (b >= 1024)::int + (b >= pow(1024.0, 2))::int + (b >= pow(1024.0, 3))::int + (b >= pow(1024.0, 4))::int
 + (b >= pow(1024.0, 5))::int) as k from (select doc_id, n_chars::double * pow(8.0, doc_id % 15) as b from documents))""",
)
def _(spark, folder):
    size = scalars.human_size(F.col("n_chars").cast("double") * F.pow(F.lit(8.0), F.col("doc_id") % 15))
    return table(spark, folder, "documents").select("doc_id", size.alias("s")).select("doc_id", rounded("s.size", 6, "size"), "s.unit")


def marked_log():
    """Conversation text with a warning line put before every sentence of a user."""
    return F.when(F.col("role") == "user", F.replace(F.col("text"), F.lit(". "), F.lit(".\nUserWarning: check\n"))).otherwise(F.col("text"))


@query(
    "drop_noise_lines_conversations",
    """select conv_id, turn, array_to_string(list_filter(string_split(case when role = 'user' then
 replace(text, '. ', chr(46) || chr(10) || 'UserWarning: check' || chr(10)) else text end, chr(10)),
 lambda l: not contains(l, 'UserWarning:')), chr(10)) as text from conversations""",
)
def _(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", scalars.drop_noise(marked_log()).alias("text"))


@query(
    "cut_middle_conversations",
    """select conv_id, turn, case when length(text) > 300 then left(text, 150) || chr(10) || '...' || chr(10) || right(text, 150)
 else text end as text from conversations""",
)
def _(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", scalars.cut_middle(F.col("text")).alias("text"))


def fenced_text():
    """Conversation messages wrapped into the four blocks; some lack one, some name a bad dependency."""
    fence = F.lit("```")
    nl = F.lit("\n")
    dependency = F.when(F.col("turn") == 2, F.lit("pip install bad name!")).when(F.col("turn") == 3, F.lit("none")).otherwise(F.lit("pip install some-lib"))
    files_out = F.when(F.col("turn") != 4, F.concat(F.lit("\nFILES_OUT:\n"), fence, nl, F.lit("b.csv"), nl, fence)).otherwise(F.lit(""))
    code = F.translate(F.col("text"), "`", "'")
    return F.concat(
        F.lit("DEPENDENCIES:\n"), fence, nl, dependency, nl, fence, F.lit("\nCODE:\n"), fence, F.lit("python\n"), code, nl, fence,
        F.lit("\nFILES_IN:\n"), fence, nl, F.lit("a.csv\n\n c.csv\n"), fence, files_out,
    )


@query(
    "fenced_blocks_conversations",
    """select conv_id, turn, case turn when 2 then 'bad name!' when 3 then '' else 'some-lib' end as dependencies,
 length(trim(translate(text, '`', ''''))) as code_length, 'a.csv,c.csv' as files_in,
 case when turn = 4 then '' else 'b.csv' end as files_out,
 case turn when 2 then 'bad dependency name: bad name!' when 4 then 'no FILES_OUT block' end as error from conversations""",
)
def _(spark, folder):
    found = table(spark, folder, "conversations").select("conv_id", "turn", scalars.fenced_blocks(fenced_text()).alias("f"))
    return found.select(
        "conv_id", "turn", F.array_join("f.dependencies", ",").alias("dependencies"), F.length("f.code").alias("code_length"),
        F.array_join("f.files_in", ",").alias("files_in"), F.array_join("f.files_out", ",").alias("files_out"), "f.error",
    )


# conversations


def log(spark, folder):
    """``conversations`` with the log fields the operators use, derived from role and turn."""
    agent = F.when(F.col("turn") % 3 == 0, "coordinator").otherwise("worker")
    visibility = F.element_at(F.array(*[F.lit(v) for v in ("all", "ui_only", "llm_only", "system_only")]), (F.col("turn") % 4 + 1).cast("int"))
    tokens = F.when(F.col("turn") % 2 == 0, F.length("text"))
    return table(spark, folder, "conversations").withColumns(
        {"agent": agent, "visibility": visibility, "token_counts": F.create_map(agent, tokens)}
    )


@query(
    "visible_history_conversations",
    """select conv_id, turn, role from conversations where turn % 4 in (0, 1) and role in ('user', 'assistant', 'tool', 'code_execution')""",
)
def _(spark, folder):
    return convlog.visible(log(spark, folder)).select("conv_id", "turn", "role")


@query(
    "last_messages_conversations",
    """select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as rn
 from conversations) where rn <= 3""",
)
def _(spark, folder):
    return convlog.last_messages(table(spark, folder, "conversations"), 3).select("conv_id", "turn", "role", "text")


@query(
    "split_at_last_marker_conversations",
    """select conv_id, turn, case when turn >= max(turn) filter (role = 'user' and length(text) > 200) over (partition by conv_id)
 then 'recent' else 'history' end as part from conversations""",
)
def _(spark, folder):
    flag = (F.col("role") == "user") & (F.length("text") > 200)
    return convlog.split_at_last(table(spark, folder, "conversations"), flag).select("conv_id", "turn", "part")


@query(
    "latest_tokens_per_agent_conversations",
    """with c as (select conv_id, turn, case when turn % 3 = 0 then 'coordinator' else 'worker' end as agent,
 case when turn % 2 = 0 then length(text) end as v from conversations), g as (select distinct conv_id, a as agent from conversations,
 (values ('coordinator'), ('worker')) t(a)), k as (select conv_id, agent, arg_max(v, turn) as v from c where v is not null group by 1, 2)
 select conv_id, agent, coalesce(v, 0) as used, round(coalesce(v, 0) / 8192, 6) as share from g left join k using (conv_id, agent)""",
)
def _(spark, folder):
    found = convlog.latest_per_agent(log(spark, folder), "token_counts", ["coordinator", "worker"], 8192)
    return found.withColumn("share", rounded("share", 6))


@query("messages_by_agent_conversations", "select conv_id, turn from conversations where turn % 3 = 0")
def _(spark, folder):
    return convlog.by_agents(log(spark, folder), "coordinator").select("conv_id", "turn")


@query(
    "last_question_conversations",
    """select conv_id, max(turn) as turn, arg_max(text, turn) as text from conversations where role = 'user' group by 1""",
)
def _(spark, folder):
    found = convlog.last_like(table(spark, folder, "conversations"), F.col("role") == "user")
    return found.select("conv_id", "turn", "text")


@query(
    "plan_progress_conversations",
    """with p as (select conv_id, list(turn::varchar order by turn) as plan, max(turn) // 2 as cur from conversations group by 1)
 select conv_id, array_to_string(list_filter(plan, lambda t: t::int <= cur), ',') as completed,
 array_to_string(list_filter(plan, lambda t: t::int > cur), ',') as remaining from p""",
)
def _(spark, folder):
    plans = table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_set("turn")), lambda t: t.cast("string")).alias("plan"),
        F.floor(F.max("turn") / 2).cast("string").alias("current"),
    )
    found = convlog.plan_progress(plans)
    return found.select("conv_id", F.array_join("completed", ",").alias("completed"), F.array_join("remaining", ",").alias("remaining"))


@query(
    "transcripts_conversations",
    """select conv_id, cast(0 as bigint) as part, string_agg('**' || upper(left(role, 1)) || substr(role, 2) || ':**' || chr(10) || chr(10)
 || replace(replace(text, 'TASK COMPLETED', '✅🎉 Task completed!'), '= CONTINUE =', '▶️') || chr(10),
 chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn) as transcript from conversations group by 1""",
)
def _(spark, folder):
    return convlog.transcript(table(spark, folder, "conversations"))


@query(
    "transformation_lineage_conversations",
    """with m as (select conv_id * 1000 + turn as key, 'd' || conv_id || '_' || turn || '.csv' as file_in,
 'd' || conv_id || '_' || (turn + 1) || '.csv' as file_out, turn from conversations),
 f as (select 'd' || conv_id || '_' || turn || '.csv' as name from conversations where role <> 'system')
 select key, file_in, file_out from m where turn % 3 <> 0 and file_in in (from f) and file_out in (from f)""",
)
def _(spark, folder):
    talk = table(spark, folder, "conversations")
    name = lambda turn: F.concat(F.lit("d"), F.col("conv_id"), F.lit("_"), turn, F.lit(".csv"))
    two = F.when(F.col("turn") % 3 == 0, F.array(name(F.col("turn")), F.lit("x.csv"))).otherwise(F.array(name(F.col("turn"))))
    messages = talk.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("key"), two.alias("files_in"), F.array(name(F.col("turn") + 1)).alias("files_out")
    )
    existing = talk.where("role <> 'system'").select(name(F.col("turn")).alias("name"))
    return diff.lineage(messages, existing)
