"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences, kinds

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_library_query_has_sql():
    from framescope.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    assert differences(df, con, SQL[name]) + kinds(df, con, SQL[name]) == []


def test_flagship(spark):
    assert entry.entry(spark).count() == 20
