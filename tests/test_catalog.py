"""Every query with SQL gives the SQL's result on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

CHECKED = sorted(entry.oracle_sql())
# At sf0.001 there may be no row of this kind.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, small, name):
    found = compare(con, entry.queries()[name](spark, small), entry.oracle_sql()[name])
    assert found == "" or (found == "EMPTY" and name in MAY_BE_EMPTY), found


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
