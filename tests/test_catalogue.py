"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, D)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in catalogue.oracle_sql():
        return
    cur = con.execute(catalogue.oracle_sql()[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == names
    assert sorted(tuple(plain(r[theirs.index(c)]) for c in names) for r in cur.fetchall()) == got


def test_entry(spark):
    assert entry.entry(spark).columns == ["symbol", "close_time", "close", "sma"]
    assert set(catalogue.queries()) <= set(entry.queries())
