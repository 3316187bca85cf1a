"""Queries with SQL agree with it on the smallest tables."""

import pytest
from oracle import compare, connect

from plumbline.llm import queries as llm

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_agrees_with_sql(spark, name):
    assert compare(connect(FOLDER), llm.QUERIES[name](spark, FOLDER), llm.SQL[name]) is None
