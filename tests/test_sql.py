from __future__ import annotations

import pytest

from compare import DATA, connect, rows
from quarrylight import queries, store_queries

QUERIES = queries.QUERIES | store_queries.QUERIES
SQL = queries.SQL | store_queries.SQL


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no test tables")
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    found = QUERIES[name](spark, str(DATA)).toPandas()
    wanted = con.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, con, name):
    found = QUERIES[name](spark, str(DATA))
    assert found.columns and found.count() >= 0
