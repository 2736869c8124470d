"""Every catalog query against its SQL on the smallest driver data."""

import pytest
from conftest import SMALL
from oracle import compare, connect

from taskloom.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_sql(spark, con, name):
    query = CATALOG[name]
    assert query.oracle
    assert compare(con, query(spark, SMALL), query.oracle) is None
