"""Every registered query against its SQL, on the smallest data."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

NAMES = list(queries())


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, folder, duck, name):
    df = queries()[name](spark, folder)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    assert differences(df, duck, sql) is None


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() == 397
    assert {"user_id", "date", "hrv_7d_mean", "acwr", "streak"} <= set(df.columns)
