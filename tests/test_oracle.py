"""Every registered query with an oracle agrees with DuckDB on the smallest tables."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from strata.sources.tables import TABLES

ORACLES = E.oracle_sql()


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "None" if math.isnan(v) else repr(round(v, 9))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, sf, con, key):
    df = E.queries()[key](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLES[key])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(rel.columns, orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "z_score" in df.columns
