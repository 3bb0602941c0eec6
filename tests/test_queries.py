"""Every query on the smallest tables, against its SQL where it has one."""

import __spark_entry__ as e
import pytest
from oracle import connect, differ

D = "/root/testdata/sf0.001"
NAMES = list(e.queries())


@pytest.fixture(scope="module")
def con():
    return connect(D)


def test_entry(spark):
    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["hour", "orders", "revenue", "average"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df, sql = e.queries()[name](spark, D), e.oracle_sql().get(name)
    if sql:
        assert differ(df, con, sql) == ""
    else:
        assert df.count() >= 0
