"""Every registered query against its checking SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry
from check import difference, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in ORACLE:
        assert len(got) > 0
        return
    want = con.sql(ORACLE[name]).df()
    if len(want) == 0:
        assert len(got) == 0 and sorted(got.columns) == sorted(want.columns)
        return
    assert difference(got, want) is None


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["dataset", "frame_group", "metric", "N", "R"] and df.count() > 0
