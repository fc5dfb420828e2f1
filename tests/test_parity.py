"""Small cases whose results are fixed by the reference's rules."""

import pytest
from pyspark.sql import functions as F

from eventfit.operators import tokens as tk
from eventfit.plans import lmscore as lm
from eventfit.sources import fixtures as fx


def test_any_hash_prefix_continues_a_word(spark):
    pieces = ["play", "##ing", "#", "#1", "a"]
    toks = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(pieces)], "sent_id long, pos int, token string")
    got = [r.word_idx for r in tk.word_groups_prefix(toks).orderBy("pos").collect()]
    assert got == [0, 0, 0, 0, 1]


def test_marker_style_word_is_found_inside_a_sentence(spark):
    s = spark.createDataFrame([(1, "The hooligans ran.", 1)], "sent_id long, text string, word_pos int")
    s = s.select("*", tk.pieces(F.col("text"), "marker").alias("pcs"))
    n = len(s.first().pcs)
    scores = spark.createDataFrame([(1, i + 1, -float(i)) for i in range(n)], "sent_id long, target_pos int, logprob double")
    pcs = s.first().pcs
    at = pcs.index("Ġhool")
    want = -sum(range(at, at + 3)) / 3
    assert lm.word_scores(s, scores, style="marker").first().score == pytest.approx(want)


def test_surprisals_are_summed_before_they_are_rounded(spark):
    s = spark.createDataFrame([(1, "x")], "sent_id long, text string")
    surp = spark.createDataFrame([(1, i, "x", 0.0000004) for i in range(10)], "sentence_id long, token_id int, token string, surprisal double")
    assert lm.sentence_surprisal(s, surp).first().surprisal == pytest.approx(0.000004)


def test_sentence_ids_are_distinct(spark):
    long_text = "A b. " * 1500
    bench = spark.createDataFrame([(1, long_text), (1_000_003, "c. d")], "item_id long, text string")
    conv = spark.createDataFrame([(c, t, f"turn {t}. end {c}") for c in (0, 1, 2) for t in range(1200)] + [(3, 0, long_text)], "conv_id long, turn int, text string")
    ids = [r.sent_id for r in fx.sentences_of(bench, conv).collect()]
    assert len(ids) == len(set(ids)) == 1500 + 2 + 3 * 1200 * 2 + 1500


def test_sentence_ids_have_no_largest_key(spark):
    bench = spark.createDataFrame([(10**12, "x. y"), (5, "A. " * 1_000_005 + "end"), (5, "A. " * 3 + "end")], "item_id long, text string")
    conv = spark.createDataFrame([(10**12, 3_000_000_000, "a. b"), (10**12 + 1, 0, "b"), (4_700_000, 7, "c")], "conv_id long, turn long, text string")
    got = fx.sentences_of(bench, conv).select("sent_id", "text")
    n = 2 + 1_000_006 + 4 + 4
    assert got.agg(F.count_distinct("sent_id"), F.min("sent_id"), F.max("sent_id"), F.count("*")).first() == (n, 0, n - 1, n)
    assert [r.text for r in got.where(F.col("sent_id") >= n - 4).orderBy("sent_id").collect()] == ["c", "a", "b", "b"]
