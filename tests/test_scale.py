"""Language-model steps that grow with the corpus: nothing whole through the driver, tokens dealt by sentence once."""

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventfit.plans import lmscore as lm
from eventfit.sources import catalog as cat

SENTS = [(1, "abcdefghij ab. abcdef", 1), (2, "b b #x b", 0), (3, "", 0), (4, "zzz abcdef. b", 2)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([("abcdefghij ab. abcdef",), ("b abcdef ab",), (None,), ("",)], "text string")
    made = {}
    for style in ("prefix", "marker"):
        uni, bi = lm.corpus_piece_counts(docs, style)
        sent = lm.lm_sentences(spark.createDataFrame(SENTS, "sent_id long, text string, word_pos int"), style)
        made[style] = [lm._stored(x, f"test_{style}_{n}") for n, x in (("uni", uni), ("bi", bi), ("sent", sent))]
    return made


@pytest.mark.parametrize("style", ["prefix", "marker"])
def test_model_tables_are_not_broadcast_because_their_files_are_small(spark, model, style):
    uni, bi, sent = model[style]
    tokens = lm.sentence_tokens(sent)
    contexts = lm._stored(lm.context_table(tokens, uni, bi), "test_contexts")
    pairs = lm._stored(lm.pair_table(tokens, uni, bi), "test_pairs")
    feats = lm.pair_features(sent, pairs, uni, style)
    for df in (lm.context_table(tokens, uni, bi), lm.pair_table(tokens, uni, bi), lm.token_features(sent, contexts, style), feats,
               lm.sentence_scores(sent, lm.token_scores(feats, "plain")), lm.word_scores(sent, lm.token_scores(feats, "plain"), style=style)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


@pytest.mark.parametrize("style", ["prefix", "marker"])
def test_pair_features_equal_context_features(spark, model, style):
    uni, bi, sent = model[style]
    want = lm.token_features(sent, lm._stored(lm.context_table(lm.sentence_tokens(sent), uni, bi), "test_contexts"), style)
    got = lm.corpus_features(sent, uni, bi, style)
    assert got.columns == want.columns
    key = lambda r: (r.sent_id, r.pos)
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        for c in got.columns:
            assert a[c] == (pytest.approx(b[c]) if isinstance(b[c], float) else b[c])


def test_sentence_queries_shuffle_no_tokens(spark):
    """Sentences and token features are dealt by sentence when they are written."""
    for key in ("span_score", "word_score_at", "word_score_at_marker", "pll_adapted_marker", "causal_ll", "surprisal_report", "score_with_udf", "score_fanout"):
        main = plan(entry.queries()[key](spark, SF_SMALL)).split("Subquer")[0]
        assert "Exchange hashpartitioning(sent" not in main, key
    assert cat.lm_feats(spark, SF_SMALL).count() == cat.lm_sents(spark, SF_SMALL).agg(F.sum(F.size("pcs"))).first()[0]


def test_sentences_that_hold_much_are_dealt_into_more_buckets(spark, tmp_path, monkeypatch):
    """A task sorts the pieces of a bucket: its size must not follow the number of shuffle partitions, nor the planner's."""
    spark.createDataFrame([(1, "abcdefghij ab. abcdef")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "ab abcdef. b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    talk = [(i, 0, "user", f"abcdefghij ab {i}. abcdef b") for i in range(200)]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(cat, "BUCKET_CHARS", 100)
    chars = cat.sents(spark, str(tmp_path)).agg(F.sum(F.length("text"))).first()[0]
    want = -(-chars // 100)
    assert want > int(spark.conf.get("spark.sql.shuffle.partitions"))
    feats, sent = cat.lm_feats(spark, str(tmp_path)), cat.lm_sents(spark, str(tmp_path))
    assert f"SelectedBucketsCount: {want} out of {want}" in plan(feats.groupBy("sent_id").count())
    assert "Exchange" not in plan(sent.join(feats.hint("merge"), "sent_id"))
    assert feats.count() == sent.agg(F.sum(F.size("pcs"))).first()[0]
    pairs, uni = (lm._stored(x, "test_dealt") for x in (cat.lm_pairs(spark, str(tmp_path)), cat.piece_unigrams(spark, str(tmp_path))))
    assert f", {want}), REPARTITION_BY_NUM" in plan(lm.pair_features(sent, pairs, uni, parts=want))
    cat.forget(spark, str(tmp_path))


def test_score_files_are_named_without_searching_their_paths(spark, tmp_path):
    """The file's name was searched for by expressions, on every line and key."""
    from eventfit.sources import readers as rd
    (tmp_path / "d.m.b.txt.d").mkdir()
    for name, folder in (("sents.bigram.verb-PLL.txt", tmp_path), ("sents.bigram.PLL.byWords.txt", tmp_path), ("a.b.c.txt", tmp_path / "d.m.b.txt.d")):
        (folder / name).write_text("1\tx y\t0.5\n")
    (tmp_path / "s.b.x.norm.txt").mkdir()
    (tmp_path / "s.b.x.norm.txt" / "part-0").write_text("2\tz\tNone\t3\t4\n")
    got = rd.read_score_matrix(spark, f"{tmp_path}/*.txt")
    assert "regexp" not in plan(got).lower().replace("split", "")
    keys = {(r.dataset, r.model, r.metric, r.norm, r.id) for r in got.collect()}
    assert keys == {("sents", "bigram", "verb-PLL", "none", 1), ("sents", "bigram", "PLL", "byWords", 1), ("s", "b", "x", "norm", 2)}


PIECES = {"abcde fg.": ["abcd", "##e", "fg", "."], "##abcde # abcdefgh": ["#", "#", "abcd", "##e", "#", "abcd", "##efgh"], "a\u0001bc\u0001defg$1 \\": ["abcd", "##efg", "$", "1", "\\"],
          "ab\U0001d538cdefg\U0001d539": ["ab\U0001d538", "cdef", "##g\U0001d539"], "abcd\U0001d538\U0001d539 \U0001f600a": ["abcd", "##\U0001d538", "\U0001d539", "\U0001f600", "a"],
          "déjàvú x": ["déjà", "##vu", "́", " ", "x"], "": [], None: None}


def test_pieces_are_cut_without_a_function_on_every_piece(spark):
    from eventfit.operators import tokens as tk
    df = spark.createDataFrame([(t,) for t in PIECES], "text string").select("text", tk.pieces(F.col("text")).alias("p"))
    assert {r.text: r.p for r in df.collect()} == PIECES
    assert "lambda" not in plan(df)


def test_tokens_travel_by_sentence_with_their_own_counts_only(spark, model):
    uni, bi, sent = model["prefix"]
    pairs = lm._stored(lm.pair_table(lm.sentence_tokens(sent), uni, bi), "test_travel")
    assert pairs.columns == ["prev", "token", "c_pt", "c_token"]
    lines = lm.pair_features(sent, pairs, uni, parts=7)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "RepartitionByExpression [sent_id" in line)
    sent_on = lines[at + 1].split("Project [")[1].split("]")[0]
    assert [c.split("#")[0] for c in sent_on.split(", ")] == ["sent_id", "pos", "token", "c_pt", "c_token"]


@pytest.mark.parametrize("style", ["prefix", "marker"])
def test_sentences_are_cut_behind_the_shuffle(spark, style):
    """Pieces are several times the bytes of their text."""
    p = cat._lm_sents(style)(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < p.index("regexp_extract_all") < p.index("RepartitionByExpression")
    assert "regexp" not in p[p.index("RepartitionByExpression"):]


def test_written_tables_are_packed_and_hold_what_queries_ask_for(spark):
    for df in (cat.sents(spark, SF_SMALL), cat.lm_feats(spark, SF_SMALL)):
        assert df.inputFiles() and all(f.endswith(".zstd.parquet") for f in df.inputFiles())
    assert cat.lm_feats(spark, SF_SMALL).columns == ["sent_id", "pos", "token", "n", "word_end", "prev", "nxt", "left_bi", "right_gain", "c_token"]
