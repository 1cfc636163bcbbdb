"""Every query with a SQL twin agrees with it on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(small):
    return connect(small)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(name, spark, small, connection):
    assert compare(entry.queries()[name](spark, small), connection, ORACLES[name]) is None
