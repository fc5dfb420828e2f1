"""Token-bounded batches for user models, and features from the table of distinct contexts."""

import pickle
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from eventfit.plans import batching
from eventfit.plans import lmscore as lm


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40).map(sorted), st.integers(1, 400))
def test_batches_stay_within_the_budget_and_cover_every_target_once(lengths, budget):
    seen = []
    for batch in batching.token_batches(lengths, budget):
        variants, longest = sum(k for _, _, k in batch), max(lengths[r] for r, _, _ in batch)
        assert variants * longest <= budget or variants == 1
        seen += [(r, t) for r, at, k in batch for t in range(at, at + k)]
    assert seen == [(r, t) for r, n in enumerate(lengths) for t in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=30).map(sorted))
def test_sentences_that_fit_a_batch_are_not_split(lengths):
    parts = [r for batch in batching.token_batches(lengths, 150) for r, _, _ in batch]
    assert parts == list(range(len(lengths)))


@pytest.mark.parametrize("budget", [1, 30, 200, 10_000])
def test_models_never_get_more_than_the_budget(spark, budget):
    s = spark.range(150).selectExpr("id AS sent_id", "transform(sequence(1, cast(1 + id % 13 as int)), i -> concat('w', id, '_', i)) AS pcs").repartition(3)
    s = s.unionByName(spark.createDataFrame([(1000, []), (1001, None)], s.schema))

    def model(pdf):
        variants, targets = batching.padded_variants(pdf)
        assert variants.size <= budget or len(variants) == 1
        assert all(v[t] == "[MASK]" for v, t in zip(variants, targets, strict=True))
        return [np.asarray(lo) * 100.0 + np.asarray(hi) for lo, hi in zip(pdf.mask_from, pdf.mask_to, strict=True)]

    got = lm.score_with_udf(s, model, "l2r", batch_tokens=budget).collect()
    assert sorted((r.sent_id, r.target_pos, r.logprob) for r in got) == [
        (i, t, t * 100.0 + 1 + i % 13) for i in range(150) for t in range(1, 2 + i % 13)]


def test_padded_variants():
    batch = pd.DataFrame({"pcs": [["a", "##b", "c"], ["d"]], "mask_from": [np.array([1, 3]), np.array([1])], "mask_to": [np.array([2, 3]), np.array([1])]})
    variants, targets = batching.padded_variants(batch)
    assert variants.tolist() == [["[MASK]", "[MASK]", "c"], ["a", "##b", "[MASK]"], ["[MASK]", "[PAD]", "[PAD]"]] and targets.tolist() == [0, 2, 0]


def test_wrong_number_of_scores_is_refused(spark):
    s = spark.createDataFrame([(1, ["a", "b"])], "sent_id long, pcs array<string>")
    with pytest.raises(Exception, match="one log-probability per target"):
        lm.score_with_udf(s, lambda pdf: [[0.0] for _ in pdf.pcs]).collect()


def test_runner_needs_no_package_on_the_executors(tmp_path):
    data = cloudpickle.dumps(batching.runner(batching.corpus_model, "adapted", "prefix", 64))
    (tmp_path / "run.pickle").write_bytes(data)
    code = ("import pickle, pandas as pd; run = pickle.load(open('run.pickle', 'rb'));"
            "df = pd.DataFrame({'sent_id': [1], 'pcs': [['a', '##b']], 'left_bi': [[-1.0, -2.0]], 'right_gain': [[0.5, None]]});"
            "print(pd.concat(run(iter([df]))).logprob.tolist())")
    out = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "[-1.0, -2.0]", out.stderr
    assert pickle.loads(data)


def test_features_join_the_tokens_once(spark):
    docs = spark.createDataFrame([("abcdefghij ab. abcdef",), ("b abcdef ab",)], "text string")
    uni, bi = lm.corpus_piece_counts(docs)
    s = lm.lm_sentences(spark.createDataFrame([(1, "abcdefghij ab zzz", 1), (2, "b b b", 0), (3, "", 0)], "sent_id long, text string, word_pos int"))
    t = lm.sentence_tokens(s)
    contexts = lm._stored(lm.context_table(t, uni, bi), "test_contexts")
    assert contexts.count() == t.select("prev", "token", "nxt").distinct().count()
    feats = lm.token_features(s, contexts)
    assert feats._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    c = {(r.prev, r.w): r.c for r in bi.collect()}
    u = {r.w: r.c for r in uni.collect()}
    n, v = sum(u.values()), len(u)
    for r in feats.collect():
        assert r.left_bi == pytest.approx(np.log((c.get((r.prev, r.token), 0) + 1) / (u.get(r.prev, 0) + v)))
        assert r.uni == pytest.approx(np.log((u.get(r.token, 0) + 1) / (n + v))) and r.c_token == u.get(r.token, 0)
        want = None if r.nxt is None else np.log((c.get((r.token, r.nxt), 0) + 1) / (u.get(r.token, 0) + v)) - np.log((u.get(r.nxt, 0) + 1) / (n + v))
        assert r.right_gain == (None if want is None else pytest.approx(want))


def test_causal_scores_equal_the_chain_of_predictions(spark):
    docs = spark.createDataFrame([("a b a",), ("b a",)], "text string")
    uni, bi = lm.corpus_piece_counts(docs)
    s = lm.lm_sentences(spark.createDataFrame([(1, "a b zz", 1), (2, "", 0), (3, "a", 0)], "sent_id long, text string, word_pos int"))
    c, u = {(r.prev, r.w): r.c for r in bi.collect()}, {r.w: r.c for r in uni.collect()}
    got = {r.sent_id: r for r in lm.causal_scores(s, lm.corpus_features(s, uni, bi), uni, exact=True).collect()}
    for r in s.collect():
        seq = ["<s>", *r.pcs, "<s>"]
        lp = [np.log((c.get(p, 0) + 1) / (u.get(p[0], 0) + len(u))) for p in zip(seq, seq[1:], strict=False)]
        assert got[r.sent_id].score == pytest.approx(sum(lp), abs=1e-6) and got[r.sent_id].score_by_tokens == pytest.approx(sum(lp) / len(lp), abs=1e-6)
    assert rows(s.select("sent_id", (F.size("pcs") + 2).alias("n"))) == sorted((i, r.n_tokens) for i, r in got.items())
