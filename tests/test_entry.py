"""The driver contract, and the catalog against DuckDB where test tables are present."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell.plans import catalog, oracles

SMALL = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def comparable(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


@have
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    cur = con.execute(oracles.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(str([comparable(v) for _, v in sorted(zip(names, row))]) for row in cur.fetchall())
    df = catalog.queries()[name](spark, SMALL)
    got = sorted(str([comparable(v) for _, v in sorted(zip(df.columns, row))]) for row in df.collect())
    assert sorted(df.columns) == sorted(names)
    assert got == want


@have
def test_entry(spark):
    assert "beta_36m" in entry.entry(spark).columns


@have
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(oracles.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0
