"""Every registered query of the event log against its SQL in DuckDB, and the entry module."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rivulet.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "customer", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "quantize"):
        v = float(v)
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(catalogue.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
