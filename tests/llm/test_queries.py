"""Every registered query of the subpackage runs on the smallest tables, and equals its SQL twin where it has one."""

import pytest

from tests import oracle
from tracelake.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        oracle.compare(spark, oracle.connection(), QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, str(oracle.DATA)).collect()
