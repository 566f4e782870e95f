"""Queries of the text operators against their SQL on DuckDB, over whole tables."""

import pytest
from oracle_check import compare, duck

from txnloom.llm import queries


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, connection, sf_dir, name):
    assert compare(spark, connection, queries.QUERIES[name], queries.ORACLES[name], sf_dir) is None
