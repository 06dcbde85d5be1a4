"""Every registered query of the index operators against its SQL, on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from shelfspark import plans

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, bool):
        return str(x)
    return f"{float(x):.6g}" if isinstance(x, (int, float)) else str(x)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
