"""Every registered query against its SQL over the smallest tables."""

import pytest
from helpers import connect, same

from ledgerlane.operators import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, db, name):
    df = registry.queries()[name](spark, sf)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        same(df, db, sql)
