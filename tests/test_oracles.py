"""Every query with SQL gives the rows of that SQL; every other query runs."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from foldloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def key(row):
    out = []
    for v in row:
        if isinstance(v, float):
            v = None if math.isnan(v) else round(v, 5) + 0.0
        out.append((v is None, str(v)))
    return out


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    if name not in catalog.ORACLES:
        assert found.columns
        return
    expected = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = [tuple(r[i] for i in order) for r in expected.fetchall()]
    assert sorted(map(key, rows)) == sorted(map(key, wanted))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
