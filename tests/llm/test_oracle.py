"""Registered queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from eventfit.llm.oracle import ORACLE
from eventfit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE[key])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(str(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want
