"""Every query with SQL gives the SQL's rows; every other one runs."""

import compare
import pytest

from tessera import plans

QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = compare.connect(sf)
    con.sql("SET TimeZone = 'UTC'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, con, name):
    assert compare.differences(QUERIES[name](spark, sf), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns
