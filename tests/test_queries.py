"""Every catalogue query runs, and equals its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.check_oracles import connect, difference

SF = "/root/testdata/sf0.001"
KEYS = list(entry.queries())


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(KEYS)
    assert entry.entry(spark).columns == ["doc_id", "cluster", "name"]


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, duck, key):
    got = entry.queries()[key](spark, SF).toPandas()
    assert len(got)
    sql = entry.oracle_sql().get(key)
    if sql is not None:
        assert difference(got, duck.execute(sql).df()) == ""
