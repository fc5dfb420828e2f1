"""A key holding a third of the rows: AQE's skew join splits it, results
stay whole and equal to the unsplit plan."""

import pytest
from pyspark.sql import functions as F

from eventfit.operators import tokens as tk
from eventfit.plans import ppmi, thematic

from conftest import rows

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _inputs(spark):
    def slots(subj, verb, obj):
        return [(0, subj, "N", "NSUBJ"), (1, verb, "V", "ROOT"), (2, obj, "N", "OBJ")]
    items = [(i, slots("cop", "arrest", "thief") if i % 3 == 0 else slots(f"s{i % 50}", f"v{i % 7}", f"o{i}"))
             for i in range(6000)]
    iw = spark.createDataFrame(items, "item_id long, slots array<struct<slot:int, lemma:string, pos:string, role:string>>")
    tr = spark.createDataFrame([("arrest@V", "thief@N", "OBJ", 40.0), ("arrest@V", "cop@N", "NSUBJ", 9.0),
                                ("v1@V", "s1@N", "NSUBJ", 3.0)] + [(f"v{i % 7}@V", f"o{i}@N", "OBJ", 2.0) for i in range(0, 6000, 5)],
                               "head string, dep string, role string, freq double")
    return iw, tr


def test_hot_key_is_split_and_results_whole(spark, skew_conf):
    iw, tr = _inputs(spark)
    df = ppmi.ppmi_syntax(iw, tr)
    got = rows(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
    assert len(got) == 6000
    hot = {r[1] for r in got if r[0] % 3 == 0}
    assert len(hot) == 1                       # every hot item has the same score
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    assert rows(ppmi.ppmi_syntax(iw, tr)) == got


def _skewed_joins(df):
    """Rows, for each sort-merge join of the plan that ran whether it was split, and the plan."""
    got = rows(df)
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    return got, [("skew=true" in j) for j in joins], plan


def _same_without_splitting(spark, build, got):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    assert rows(build()) == got


def test_verb_marginal_join_is_split(spark, skew_conf):
    """A third of the items have one verb and role but different words: hot in the verb's marginal only."""
    def slots(i):
        return [(0, f"s{i}", "N", "NSUBJ"), (1, "arrest" if i % 3 == 0 else f"v{i}", "V", "ROOT"), (2, f"o{i}", "N", "OBJ")]
    iw = spark.createDataFrame([(i, slots(i)) for i in range(6000)],
                               "item_id long, slots array<struct<slot:int, lemma:string, pos:string, role:string>>")
    tr = spark.createDataFrame([("arrest@V", f"o{i}@N", "OBJ", 2.0) for i in range(0, 6000, 3)], "head string, dep string, role string, freq double")
    got, split, plan = _skewed_joins(ppmi.ppmi_syntax(iw, tr))
    assert split.count(True) >= 1, plan
    assert len(got) == 6000
    _same_without_splitting(spark, lambda: ppmi.ppmi_syntax(iw, tr), got)


def test_hot_pair_word_is_split(spark, skew_conf):
    pairs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), "id")).alias("w1"),
                                     F.concat(F.lit("w"), F.col("id") + 1).alias("w2"), F.lit(1.0).alias("freq"))
    words = spark.range(6002).select(F.concat(F.lit("w"), "id").alias("word")).union(spark.createDataFrame([("hot",)], "word string"))
    build = lambda: ppmi.pairs_in_vocab(pairs, words, words.distinct())
    got, split, plan = _skewed_joins(build())
    assert len(split) == 2 and any(split), plan
    assert len(got) == 6000
    _same_without_splitting(spark, build, got)


@pytest.mark.parametrize("seen", [True, False])
def test_hot_context_is_split(spark, skew_conf, seen):
    rows_ = [(f"k{i}", [("hot" if i % 3 == 0 else f"w{i}", "N", "OBJ")], "OBJ") for i in range(6000)]
    keys = spark.createDataFrame(rows_, "ctx_key string, ctx array<struct<lemma:string, pos:string, role:string>>, t_role string")
    bigrams = spark.createDataFrame([("hot@N@OBJ", "x@N@OBJ", 1.0), ("w1@N@OBJ", "y@N@OBJ", 1.0)], "a1 string, a2 string, freq double")
    build = lambda: (thematic.attested_contexts if seen else thematic.unattested_contexts)(keys, bigrams)
    got, split, plan = _skewed_joins(build())
    assert split and all(split), plan
    assert len(got) == (2001 if seen else 3999)
    _same_without_splitting(spark, build, got)


def test_hot_softmax_key_is_split(spark, skew_conf):
    logits = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("prev"),
                                      F.concat(F.lit("c"), "id").alias("cand"), (F.col("id") % 11).cast("double").alias("logit"))
    targets = logits.select("prev", F.col("cand").alias("target"))
    build = lambda: tk.log_softmax_gather(logits, targets, ["prev"]).select("prev", "target", F.round("logprob", 9).alias("lp"))
    got, split, plan = _skewed_joins(build())
    assert len(split) == 2 and any(split), plan
    assert len(got) == 6000
    _same_without_splitting(spark, build, got)
