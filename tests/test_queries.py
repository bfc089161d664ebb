"""Every registered query with a SQL twin gives the twin's rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connection

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, SQL[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
