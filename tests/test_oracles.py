"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import pytest

from oracle import connection, spark_rows, sql_rows

SF = os.environ.get("DOCLOOM_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def _names():
    from docloom.plans.queries import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", _names())
def test_same_rows(spark, con, name):
    from docloom.plans.queries import ORACLES, QUERIES

    columns, rows = spark_rows(QUERIES[name](spark, SF))
    expected_columns, expected = sql_rows(con, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
