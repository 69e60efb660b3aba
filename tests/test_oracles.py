"""Every registered query against its SQL; those without SQL run and keep their schema."""

import os

import pytest

from quillmill.plans import registry

from .oracle import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_rows(spark, name):
    one, two = QUERIES[name](spark, SF_DIR), QUERIES[name](spark, SF_DIR)
    assert one.schema == two.schema
    one.collect()
