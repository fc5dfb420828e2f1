"""Every registered query against its DuckDB oracle on the smallest driver
tables (the driver runs the same comparison at sf0.01), the entry smoke
check."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from eventfit.oracle import ORACLE
from eventfit.registry import QUERIES
from eventfit.sources.tables import TABLES

from conftest import SF_SMALL


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _digest(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in recs)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    got = _digest(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[key])
    cols = [d[0] for d in cur.description]
    exp = _digest(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == exp
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "score", "raw_freq", "n_parts"]
    assert df.count() > 0
