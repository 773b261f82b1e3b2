"""Every registered query against its SQL, over the smallest given tables."""
import pytest
from compare import compare, duck

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Rules that may have no row at this size.
MAY_BE_EMPTY = {"stream_load_stats", "monotonicity"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    problem = compare(QUERIES[name](spark, sf), con, SQL[name])
    assert problem is None or (problem == "EMPTY" and name in MAY_BE_EMPTY), problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
