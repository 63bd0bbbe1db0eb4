"""Every registered query with SQL equals it; the entry point runs."""

import pytest
from compare import DATA, connect, differences

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect("0.001")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, f"{DATA}/sf0.001")
    assert differences(got, con, ORACLES[name]) == []


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["n"] > 0 and row["accuracy"] > 0.5
