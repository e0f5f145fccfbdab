import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sluicewire.suite import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in os.listdir(DIR):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DIR}/{t}'")
    return con


def plain(v):
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, tables, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    res = tables.sql(ORACLE_SQL[name])
    assert sorted(res.columns) == cols
    want = sorted(repr([plain(dict(zip(res.columns, r, strict=True))[c]) for c in cols]) for r in res.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql()) and set(QUERIES) == set(ORACLE_SQL)
