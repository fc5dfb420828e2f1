"""Physical plan checks: pruning, pushdown, bounded broadcasts, no
single-partition windows over data, and results independent of the number
of shuffle partitions."""

import pytest

import __spark_entry__ as entry
from eventfit.sources import fixtures as fx

from conftest import SF_SMALL, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pruning_and_pushdown(spark):
    p = plan(fx.vectors(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(label), Not(EqualTo(label,0))]" in p
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in p
    b = plan(fx.base_counts(spark, SF_SMALL))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_returnflag:string,l_linestatus:string>" in b


def test_no_cartesian_products(spark):
    for key in ("ppmi_syntax", "tf_score", "pll_adapted", "corpus_pair_counts", "pair_ppmi"):
        p = plan(entry.queries()[key](spark, SF_SMALL))
        assert "CartesianProduct" not in p, key


@pytest.mark.parametrize("key", ["ppmi_syntax", "pair_ppmi", "pll_adapted", "filler_rank", "sentence_number",
                                 "corpus_pair_counts"])
def test_partition_count_invariance(spark, key):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    q = entry.queries()[key]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = rows(q(spark, SF_SMALL))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = rows(q(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b and len(a) > 0
