"""Every registered query of the dialect against DuckDB."""

import pytest
from duck import assert_same, oracle, plain

from fedframe import queries as registered

QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, sf):
    assert_same(QUERIES[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", ["sort_multi", "sort_nulls_last", "sort_nulls_default", "case_order_by"])
def test_order(name, spark, sf):
    names, rows = oracle(SQL[name], sf)
    got = [tuple(plain(r[x]) for x in names) for r in QUERIES[name](spark, sf).collect()]
    assert got == [tuple(map(plain, r)) for r in rows]


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
