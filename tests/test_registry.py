"""Every registered query against its DuckDB oracle on the smallest scale (the driver uses sf0.01)."""

import pytest

import __spark_entry__ as se
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = se.oracle_sql()
QUERIES = se.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert ok, msg


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() > 0 and df.columns == ["category", "total_revenue", "avg_revenue", "transactions"]


def test_every_query_has_builder():
    assert set(ORACLES) <= set(QUERIES)
