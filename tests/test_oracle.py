"""Every catalogue query agrees with its SQL counterpart on the smallest tables."""

import pytest
from oracle import connect, difference, spark_rows, sql_rows

from atticwork.plans import CATALOG

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    query = CATALOG[name]
    mine = spark_rows(query(spark, DIRECTORY))
    if query.sql is None:
        assert mine[1]
    else:
        assert difference(mine, sql_rows(con, query.sql)) is None


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
