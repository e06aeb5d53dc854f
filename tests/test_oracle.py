import pytest

import __spark_entry__ as entry
from tests.oracle import connect, same
from weftline.plans import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, con, name):
    sql = oracle.oracle_sql().get(name)
    if sql is None:
        assert queries.queries()[name](spark, SF).count() > 0
        return
    equal, got = same(spark, con, queries.queries()[name], sql, SF)
    assert equal, got[1][:3]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
