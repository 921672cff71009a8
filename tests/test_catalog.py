"""Every query of the library, without the optional subpackage, against DuckDB on the smallest tables."""

import pytest

from plyframe import catalog
from tests.against import connect, rows_of, rows_of_sql

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(tables):
    return connect(tables)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, con, name):
    assert rows_of(QUERIES[name](spark, tables)) == rows_of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tables, name):
    assert QUERIES[name](spark, tables).columns
