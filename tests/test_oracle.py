"""Every query against its SQL in DuckDB; those without SQL must give rows and a stable schema."""

import os

import pytest

from chronolith.plans.catalogue import QUERIES, SQL

from .oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    compare(spark, con, SF_DIR, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.columns and df.collect() is not None
