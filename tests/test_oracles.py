"""Every registered query with a SQL twin gives the same rows and values."""

import pytest
from compare import compare, duck
from conftest import SF

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    diff = compare(entry.queries()[name](spark, SF), con, ORACLES[name])
    assert diff is None, diff


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 0 and rows[0].total_revenue >= rows[-1].total_revenue
