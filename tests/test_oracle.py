"""Every registered key against its DuckDB oracle on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as E
from tools.oracle_check import digest, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_key_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(key)
    if sql is None:
        assert len(srows) > 0
        return
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["convencion", "nombre_completo", "total_encuestas"]
    assert df.count() >= 0
