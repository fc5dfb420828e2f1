"""Counting, ranking, token and LM operators against brute force on invented
rows, plus the properties of SURVEY section 5."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventfit.operators import counting as cnt
from eventfit.operators import ranking as rk
from eventfit.operators import tokens as tk
from eventfit.plans import lmscore as lm

from conftest import rows

DOCS = [(1, "the cop arrests the thief the cop".split()), (2, "a dog barks at the cop".split()),
        (3, ("x " * 30).split())]


@pytest.fixture(scope="module")
def toks(spark):
    return spark.createDataFrame([(d, i, w) for d, ws in DOCS for i, w in enumerate(ws)],
                                 "doc_id long, pos int, tok string")


@pytest.mark.parametrize("window,chunk", [(1, 1024), (3, 1024), (10, 1024), (3, 4), (10, 7)])
def test_window_pairs_brute_force(spark, toks, window, chunk):
    exp = Counter()
    for _, ws in DOCS:
        for i, a in enumerate(ws):
            for j in range(i + 1, min(len(ws), i + window + 1)):
                exp[(a, ws[j])] += 1
    got = {(r.w1, r.w2): r.freq for r in cnt.window_pair_counts(toks, None, window, chunk=chunk).collect()}
    assert got == {k: float(v) for k, v in exp.items()}


def test_window_pairs_vocab_pruning_keeps_positions(spark, toks):
    vocab = spark.createDataFrame([("the",), ("thief",), ("cop",)], "word string")
    got = {(r.w1, r.w2): r.freq for r in cnt.window_pair_counts(toks, vocab, 2).collect()}
    keep = {"the", "thief", "cop"}
    exp = Counter()
    for _, ws in DOCS:
        for i, a in enumerate(ws):
            for j in range(i + 1, min(len(ws), i + 3)):
                if a in keep and ws[j] in keep:
                    exp[(a, ws[j])] += 1
    # 'arrests' is dropped but still occupies its position: cop .. the is distance 2
    assert got == {k: float(v) for k, v in exp.items()} and got[("cop", "the")] == 1.0


def test_marginals_sum_to_twice_n(spark):
    t = spark.createDataFrame([("v1@V", "n1@N", "OBJ", 3.0), ("v1@V", "v1@V", "OBJ", 2.0), ("v2@V", "n1@N", "NSUBJ", 5.0)],
                              "head string, dep string, role string, freq double")
    m = cnt.word_role_marginals(t)
    tot = cnt.triple_totals(t).first()
    assert m.agg(F.sum("f")).first()[0] == 2 * tot.n
    assert dict(((r.w, r.role), r.f) for r in m.collect())[("v1@V", "OBJ")] == 3.0 + 2.0 + 2.0  # head = dep counts twice
    assert tot.v == 3.0


def test_dense_index_and_sentence_index(spark):
    df = spark.createDataFrame([(w,) for w in "d b a c b a e".split()], "w string").repartition(3)
    assert rows(rk.dense_index(df, "w", "k")) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)]
    ids = spark.range(0, 50, 3).toDF("sent_id").repartition(4)
    out = rows(cnt.sentence_index(ids, ["sent_id"], "idx"))
    assert out == [(i * 3, i) for i in range(17)]


def test_top_n_and_dedupe_last(spark):
    df = spark.createDataFrame([("g", "a", 3.0), ("g", "b", 3.0), ("g", "c", 1.0), ("h", "a", 2.0)],
                               "g string, f string, w double")
    top = rk.top_n(df, ["g"], [F.col("w").desc(), F.col("f")], 2)
    assert rows(top, "g", "f") == [("g", "a"), ("g", "b"), ("h", "a")]
    d = spark.createDataFrame([("k", 1.0, 1), ("k", 7.0, 3), ("k", 5.0, 2)], "k string, v double, o int")
    assert rows(rk.dedupe_last(d, ["k"], ["v"], "o")) == [("k", 7.0)]
    assert rows(rk.dedupe_sum(d, ["k"], "v")) == [("k", 13.0)]


def test_pieces_and_word_groups(spark):
    df = spark.createDataFrame([(1, "The hooligans ran."), (2, "I saw U.S. cars")], "sent_id long, text string")
    p = df.select("sent_id", tk.pieces(F.col("text")).alias("pcs"))
    got = dict(rows(p))
    assert got[1] == ["The", "hool", "##igan", "##s", "ran", "."]
    assert got[2] == ["I", "saw", "U", ".", "S", ".", "cars"]
    m = dict(rows(df.select("sent_id", tk.pieces(F.col("text"), "marker").alias("pcs"))))
    assert m[1] == ["The", "Ġhool", "igan", "s", "Ġran", "."]
    wg = tk.word_groups_prefix(tk.explode_tokens(p, "sent_id", "pcs"))
    assert [r.word_idx for r in wg.where("sent_id = 1").orderBy("pos").collect()] == [0, 1, 1, 1, 2, 3]
    wm = tk.word_groups_marker(tk.explode_tokens(df.select("sent_id", tk.pieces(F.col("text"), "marker").alias("pcs")),
                                                 "sent_id", "pcs"))
    # a period is a word of its own and the next piece starts a new word
    assert [r.word_idx for r in wm.where("sent_id = 2").orderBy("pos").collect()] == [0, 1, 2, 3, 4, 5, 6]


def test_mask_plans_properties(spark):
    df = spark.createDataFrame([(1, "The hooligans ran."), (2, "A dog ran.")], "sent_id long, text string")
    p = df.select("sent_id", tk.pieces(F.col("text")).alias("pcs"))
    t = tk.word_groups_prefix(tk.explode_tokens(p, "sent_id", "pcs"))
    n = t.groupBy("sent_id").agg(F.count(F.lit(1)).alias("n"))
    for kind in ("plain", "l2r", "adapted"):
        plan = tk.mask_plan(t, kind).join(n, "sent_id")
        ex = tk.expand(plan)
        sizes = dict(rows(ex.groupBy("sent_id").count()))
        assert sizes == {1: 36, 2: 16}                      # n * n positions per sentence
    adapted = {(r.sent_id, r.target_pos): (r.mask_from, r.mask_to) for r in tk.mask_plan(t, "adapted").collect()}
    assert adapted[(1, 2)] == (2, 4) and adapted[(1, 3)] == (3, 4) and adapted[(1, 4)] == (4, 4)
    plain = {(r.sent_id, r.target_pos): (r.mask_from, r.mask_to) for r in tk.mask_plan(t, "plain").collect()}
    # every word of sentence 2 is one piece: adapted = plain
    assert all(adapted[k] == plain[k] for k in plain if k[0] == 2)


def test_locate_span(spark):
    data = [(["a", "hool", "##igan", "hit", "a", "hool", "##igan"], ["hool", "##igan"]),
            (["hool", "x", "hool"], ["hool", "##igan"]),
            (["a", "b"], ["c"]), (["a", "b."], ["b", "."])]
    df = spark.createDataFrame(data, "s array<string>, w array<string>")
    got = [r.start for r in df.select(tk.locate_span(F.col("s"), F.col("w")).alias("start")).collect()]
    assert got == [2, 3, None, None]


def test_log_softmax_gather(spark):
    lg = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 2.0), ("p", "c", 3.0)], "prev string, cand string, logit double")
    tg = spark.createDataFrame([("p", "b"), ("p", "z")], "prev string, target string")
    got = dict(rows(tk.log_softmax_gather(lg, tg, ["prev"]).select("target", "logprob")))
    z = math.log(math.exp(1) + math.exp(2) + math.exp(3))
    assert got["b"] == pytest.approx(2 - z) and got["z"] is None


def test_piece_model_counts_and_surprisal(spark):
    docs = spark.createDataFrame([("a b a",), ("b a",), ("",)], "text string")
    uni, bi = lm.corpus_piece_counts(docs)
    assert dict(rows(uni)) == {"<s>": 3.0, "a": 3.0, "b": 2.0}
    assert {(r.prev, r.w): r.c for r in bi.collect()} == {("<s>", "a"): 1.0, ("a", "b"): 1.0, ("b", "a"): 2.0,
                                                          ("<s>", "b"): 1.0}
    s = lm.lm_sentences(spark.createDataFrame([(1, "a b zz", 1), (2, "", 0)], "sent_id long, text string, word_pos int"))
    surp = lm.surprisal_table(lm.corpus_features(s, uni, bi))
    got = {(r.sentence_id, r.token_id): (r.token, r.surprisal) for r in surp.collect()}
    v = 3.0
    assert got[(1, 1)] == ("a", pytest.approx(-math.log2((1 + 1) / (3 + v)), abs=1e-6))
    assert got[(1, 3)][0] == "UNK"
    rep = {r.sent_id: r for r in lm.surprisal_report(s, surp).collect()}
    # "zz" and the final "." never occur in the corpus
    assert rep[1].unk == "unk" and rep[1].sentence == "a b UNK UNK"
    tot = {r.sent_id: r.surprisal for r in lm.sentence_surprisal(s, surp).collect()}
    assert tot[2] == pytest.approx(sum(v[1] for k, v in got.items() if k[0] == 2))


def test_length_normalisation_property(spark):
    s = lm.lm_sentences(spark.createDataFrame([(1, "a b a b", 1), (2, "b", 0)], "sent_id long, text string, word_pos int"))
    uni, bi = lm.corpus_piece_counts(spark.createDataFrame([("a b a",), ("b a",)], "text string"))
    feats = lm.corpus_features(s, uni, bi)
    sc = lm.sentence_scores(s, lm.token_scores(feats, "plain"))
    for r in sc.collect():
        assert r.score_by_tokens * r.n_tokens == pytest.approx(r.score, abs=1e-5)
        assert r.score_by_words * r.n_words == pytest.approx(r.score, abs=1e-5)


def test_udf_scores_equal_jvm_scores_under_every_plan(spark):
    s = lm.lm_sentences(spark.createDataFrame([(1, "abcdefghij ab. abcdef", 1), (2, "b", 0), (3, "", 0)],
                                              "sent_id long, text string, word_pos int"))
    uni, bi = lm.corpus_piece_counts(spark.createDataFrame([("abcdefghij ab",), ("b abcdef",)], "text string"))
    feats = lm.corpus_features(s, uni, bi)
    for kind in ("plain", "l2r", "adapted"):
        jvm = {(r.sent_id, r.target_pos): r.logprob for r in lm.token_scores(feats, kind).collect()}
        udf = {(r.sent_id, r.target_pos): r.logprob for r in lm.score_with_udf(lm.sentence_features(feats), kind=kind).collect()}
        assert udf.keys() == jvm.keys() and all(udf[k] == pytest.approx(jvm[k]) for k in jvm)


@pytest.mark.parametrize("style", ["prefix", "marker"])
def test_mask_ranges_agree_in_all_three_forms(spark, style):
    """Window plan, feature rows and the ranges a user model receives."""
    pcs = {"prefix": ["##a", "b", "##c", "##d", ".", "#", "e"], "marker": ["a", "b", "\u0120c", "d", ".", "e", "f", "[SEP]"]}[style]
    s = spark.createDataFrame([(1, pcs), (2, pcs[:1]), (3, [])], "sent_id long, pcs array<string>")
    n = s.select("sent_id", F.size("pcs").alias("n"))
    toks = tk.explode_tokens(s, "sent_id", "pcs").join(n, "sent_id")
    for kind in ("plain", "l2r", "adapted"):
        want = rows(lm.mask_plan_for(s, kind, style), "sent_id", "target_pos", "mask_to")
        assert rows(tk.word_ends(toks, style).select("sent_id", "pos", tk.mask_range_end(kind).alias("to")), "sent_id", "pos", "to") == want
        assert [(i, j + 1, int(e)) for i, p in ((1, pcs), (2, pcs[:1])) for j, e in enumerate(lm.mask_ends(p, kind, style))] == want


def test_user_model_sees_whole_sentences(spark):
    """Batches of one row: a model that needs all pieces of its sentence still gets them, whatever the partitions."""
    s = spark.range(200).selectExpr("id AS sent_id", "transform(sequence(0, cast(id % 7 as int)), i -> concat('w', id, '_', i)) AS pcs").repartition(4)

    def model(pdf):
        for sid, p, lo, hi in zip(pdf.sent_id, pdf.pcs, pdf.mask_from, pdf.mask_to, strict=True):
            assert list(p) == [f"w{sid}_{i}" for i in range(sid % 7 + 1)] and list(lo) == list(range(1, len(p) + 1)) and set(hi) == {len(p)}
        return [[float(len(p))] * len(p) for p in pdf.pcs]

    got = lm.score_with_udf(s, model, "l2r").collect()
    assert sorted((r.sent_id, r.target_pos, r.logprob) for r in got) == [(i, j + 1, i % 7 + 1.0) for i in range(200) for j in range(i % 7 + 1)]


def test_rank_within_spread_hot_group(spark):
    # one group holds most rows, ties broken by the second order column
    data = [("hot", float(i % 7), f"f{i:03d}") for i in range(300)] + [("cold", 1.0, "a"), ("cold", 2.0, "b")]
    df = spark.createDataFrame(data, "g string, w double, f string").repartition(5)
    order = [F.col("w").desc(), F.col("f").asc()]
    got = rows(rk.rank_within_spread(df, ["g"], order), "g", "f", "rk")
    exp = rows(rk.rank_within(df, ["g"], order), "g", "f", "rk")
    assert got == exp


def test_locate_span_last_occurrence(spark):
    df = spark.createDataFrame([(["a", "x", "y", "a", "x", "y"], ["a", "x"])], "s array<string>, w array<string>")
    r = df.select(tk.locate_span(F.col("s"), F.col("w")).alias("first"),
                  tk.locate_span(F.col("s"), F.col("w"), last=True).alias("last")).first()
    assert (r.first, r.last) == (1, 4)
