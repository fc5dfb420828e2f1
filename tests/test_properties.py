"""Property tests with generated inputs."""

import math
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventfit.operators import counting as cnt
from eventfit.plans import thematic as tf

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(docs=st.lists(st.lists(st.sampled_from("abcde"), min_size=0, max_size=40), min_size=1, max_size=4),
       window=st.integers(1, 6), chunk=st.integers(1, 9))
def test_window_pairs_any_chunking(spark, docs, window, chunk):
    rows_ = [(d, i, w) for d, ws in enumerate(docs) for i, w in enumerate(ws)]
    toks = spark.createDataFrame(rows_, "doc_id long, pos int, tok string")
    exp = Counter()
    for ws in docs:
        for i, a in enumerate(ws):
            for j in range(i + 1, min(len(ws), i + window + 1)):
                exp[(a, ws[j])] += 1
    got = {(r.w1, r.w2): r.freq for r in cnt.window_pair_counts(toks, None, window, chunk=chunk).collect()}
    assert got == {k: float(v) for k, v in exp.items()}


@SETTINGS
@given(weights=st.lists(st.lists(st.floats(0.5, 50.0), min_size=3, max_size=3), min_size=2, max_size=3))
def test_prod_is_add_in_log_space(spark, weights):
    # contexts li = 0..k-1 of one key; fillers f0..f2 with positive weights in every list
    att = spark.createDataFrame([("key", "T", li, f"c{li}") for li in range(len(weights))],
                                "ctx_key string, t_role string, li int, w string")
    topn = spark.createDataFrame([(f"c{li}", "T", f"f{j}", ws[j]) for li, ws in enumerate(weights) for j in range(3)],
                                 "w string, t_role string, filler string, weight double")
    prod = {r.filler: r.score for r in tf.intersection(att, topn, "prod").collect()}
    logs = topn.withColumn("weight", F.log("weight"))
    add = {r.filler: r.score for r in tf.intersection(att, logs, "add").collect()}
    assert prod.keys() == add.keys() == {"f0", "f1", "f2"}
    for f in prod:
        assert math.isclose(prod[f], math.exp(add[f]), rel_tol=1e-6)
