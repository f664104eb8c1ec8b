"""All queries with SQL, against DuckDB on the smallest tables; the others must give a stable schema."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from framespark.plans import feature_queries, general_queries, pipeline_queries, signal_queries, spectral_queries, stream_queries

CORE = [general_queries, signal_queries, feature_queries, spectral_queries, pipeline_queries, stream_queries]
SQL = {n: s for m in CORE for n, s in m.ORACLE.items()}
ALL = {n: q for m in CORE for n, q in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def flat(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(flat, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    df = ALL[name](spark, data)
    cols = sorted(df.columns)
    r = duck.execute(SQL[name])
    own = [x[0] for x in r.description]
    assert sorted(own) == cols
    at = [own.index(c) for c in cols]
    theirs = sorted("|".join(flat(x[i]) for i in at) for x in r.fetchall())
    assert sorted("|".join(flat(x[c]) for c in cols) for x in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL) - {"vtln"}))
def test_invariants(spark, data, name):
    """Of queries without SQL: rows, each key once, and frames of one width with finite values. Maps and warps have tests of their own."""
    df = ALL[name](spark, data)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    keys = [c for c in ("item", "signal_id", "frame", "g") if c in df.columns]
    assert keys and len({tuple(r[k] for k in keys) for r in rows}) == len(rows)
    if "vec" in df.columns:
        assert len({len(r.vec) for r in rows}) == 1 and all(math.isfinite(x) for r in rows for x in r.vec)
        assert all(r.frame >= 0 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
