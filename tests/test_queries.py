"""Every query with SQL agrees with it on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from plumbline.plans import load_all

FOLDER = "/root/testdata/sf0.001"
SQL = load_all().SQL
# operators that take another way for small tables; all queries take it in `python tests/check_all.py --distributed`
TWO_WAYS = ("kaplan_meier", "subgroup", "survival", "concordance", "quantil", "numeric_describe", "iqr_outliers", "conformal", "distribution_distances", "neighbour", "nearest", "undersample", "oversample", "common_rows", "knn", "table_one", "class_privacy")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(con, entry.queries()[name](spark, FOLDER), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(n for n in SQL if n.startswith(TWO_WAYS)))
def test_query_agrees_with_sql_without_shortcuts(spark, con, distributed, name):
    assert compare(con, entry.queries()[name](spark, FOLDER), SQL[name]) is None


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 8
