"""Every registered query against its SQL on DuckDB, over whole tables."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as registry
from txnloom.plans.catalog import ENTRIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n in ENTRIES if n != "train_gbt"))
def test_query_equals_sql(spark, connection, sf_dir, name):
    run, sql = registry.queries()[name], registry.oracle_sql()[name]
    assert compare(spark, connection, run, sql, sf_dir) is None


def test_every_query_has_sql():
    assert all(e.oracle for e in ENTRIES.values())


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert sum(r["count"] for r in rows) == 1500
