"""Every registered query of the core runs, and equals its SQL twin where it has one."""

import pytest

from tests import oracle
from tracelake import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    oracle.compare(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, str(oracle.DATA))
    assert frame.columns
    frame.collect()


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
