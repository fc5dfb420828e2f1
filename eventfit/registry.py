"""Query registry: one callable ``(spark, sf_dir) -> DataFrame`` per key of
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .constants import LEMMA_POS_MIN_FREQ, TF_CENTROID_SIZE, TF_LIST_LENGTH, TF_UPDATE, TF_WEIGHT
from .functions import assoc
from .functions import text as tx
from .functions import vectors as vx
from .operators import counting as cnt
from .operators import tokens as tk
from .operators import ranking as rk
from .operators.ranking import with_scalars
from .plans import lmscore as lm
from .plans import ppmi
from .plans import reports as rp
from .plans import sweep
from .plans import thematic as tf
from .session import scratch_path, written
from .sources import catalog as cat
from .sources import fixtures as fx
from .sources import readers as rd
from .sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def mapped_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 applied to the corpus triple table (materialised once)."""
    return cat.triples(spark, sf_dir)


@query("ppmi_syntax")
def q_ppmi_syntax(spark, sf_dir):
    return ppmi.ppmi_syntax(cat.items_wide(spark, sf_dir), mapped_triples(spark, sf_dir), smooth=True)


@query("ppmi_syntax_raw")
def q_ppmi_syntax_raw(spark, sf_dir):
    return ppmi.ppmi_syntax(cat.items_wide(spark, sf_dir), mapped_triples(spark, sf_dir), smooth=False)


# ------------------------------------------------------------ association



def _comp_stats(spark, sf_dir):
    return ppmi.syntax_stats(cat.items_wide(spark, sf_dir), mapped_triples(spark, sf_dir))


def _measure_over_components(fn):
    def q(spark, sf_dir):
        s = _comp_stats(spark, sf_dir)
        ab, a, b, n, v = (F.col(c) for c in ("ab", "a", "b", "n", "vocab"))
        return s.select("item_id", "part", F.round(fn(ab, a, b, n, v), 6).alias("value"))
    return q


QUERIES["assoc_mi"] = _measure_over_components(lambda ab, a, b, n, v: assoc.mi(ab, a, b, n))
QUERIES["assoc_ppmi"] = _measure_over_components(lambda ab, a, b, n, v: assoc.ppmi(ab, a, b, n))
QUERIES["assoc_laplace"] = _measure_over_components(assoc.laplace)


def bigram_stats(spark, sf_dir):
    """Every bigram with its two lemma@pos marginals and the verb total
    (J6, A8): the inputs of the thematic-fit weight functions."""
    bg = cat.bigrams(spark, sf_dir)
    lp = cat.lemma_pos_freqs(spark, sf_dir)
    x = lp.select(F.col("lemma_pos").alias("k1"), F.col("freq").alias("a"))
    y = lp.select(F.col("lemma_pos").alias("k2"), F.col("freq").alias("b"))
    s = (bg.withColumn("k1", tx.strip_role(F.col("a1"))).withColumn("k2", tx.strip_role(F.col("a2")))
         .join(x, "k1").join(y, "k2"))
    return with_scalars(s, cnt.verb_total(lp)).select(
        "a1", "a2", F.col("freq").alias("ab"), "a", "b", F.col("n_verb").alias("n"))


def _measure_over_bigrams(fn):
    def q(spark, sf_dir):
        s = bigram_stats(spark, sf_dir)
        ab, a, b, n = (F.col(c) for c in ("ab", "a", "b", "n"))
        return s.select("a1", "a2", F.round(fn(ab, a, b, n), 6).alias("value"))
    return q


QUERIES["assoc_mi_strict"] = _measure_over_bigrams(assoc.mi_strict)
QUERIES["assoc_lmi"] = _measure_over_bigrams(assoc.lmi)
QUERIES["assoc_cprob"] = _measure_over_bigrams(lambda ab, a, b, n: assoc.c_prob(ab, b, a, n))
QUERIES["assoc_cprob_simple"] = _measure_over_bigrams(lambda ab, a, b, n: assoc.c_prob_simple(ab, a))


@query("assoc_by_name")
def q_assoc_by_name(spark, sf_dir):
    s = bigram_stats(spark, sf_dir)
    ab, a, b, n = (F.col(c) for c in ("ab", "a", "b", "n"))
    return s.select("a1", "a2", *[F.round(assoc.by_name(k)(ab, a, b, n), 6).alias(k) for k in ("lmi", "ppmi")])


# --------------------------------------------------------------- counting
@query("word_role_marginals")
def q_marginals(spark, sf_dir):
    return cnt.word_role_marginals(mapped_triples(spark, sf_dir))


@query("triple_total")
def q_triple_total(spark, sf_dir):
    return cnt.triple_totals(mapped_triples(spark, sf_dir))


@query("verb_total")
def q_verb_total(spark, sf_dir):
    return cnt.verb_total(cat.lemma_pos_freqs(spark, sf_dir))


@query("attested_args")
def q_attested_args(spark, sf_dir):
    return cnt.attested_args(cat.bigrams(spark, sf_dir))


LEMMA_MIN, PAIR_MIN, PAIR_WINDOW, TRIPLE_MIN = cat.LEMMA_MIN, cat.PAIR_MIN, cat.PAIR_WINDOW, cat.TRIPLE_MIN


def corpus_lemmas(spark, sf_dir):
    return cat.lemmas(spark, sf_dir)


@query("corpus_lemma_counts")
def q_corpus_lemmas(spark, sf_dir):
    return cnt.lemma_counts(cat.toks(spark, sf_dir), LEMMA_MIN)


@query("corpus_pair_counts")
def q_corpus_pairs(spark, sf_dir):
    return cnt.window_pair_counts(cat.toks(spark, sf_dir), corpus_lemmas(spark, sf_dir), PAIR_WINDOW, PAIR_MIN)


@query("corpus_triple_counts")
def q_corpus_triples(spark, sf_dir):
    return cnt.triple_counts(spark, sf_dir, min_freq=TRIPLE_MIN)


@query("min_freq")
def q_min_freq(spark, sf_dir):
    return cat.triples_raw(spark, sf_dir).where(F.col("freq") >= TRIPLE_MIN)


# -------------------------------------------------------------- pair PPMI
def pair_inputs(spark, sf_dir):
    """Items (whole sentences as lemma lists), the lemma table and the
    corpus pair table (S8 restricts it to the item vocabulary)."""
    s = cat.sents(spark, sf_dir)
    items = ppmi.pair_items(s.select(F.col("sent_id").alias("item_id"),
                                     tx.corpus_tokens(F.col("text")).alias("words")))
    return items, corpus_lemmas(spark, sf_dir), cat.pairs(spark, sf_dir)


@query("pair_ppmi")
def q_pair_ppmi(spark, sf_dir):
    return ppmi.pair_ppmi(*pair_inputs(spark, sf_dir), smooth=True)


@query("pair_ppmi_raw")
def q_pair_ppmi_raw(spark, sf_dir):
    return ppmi.pair_ppmi(*pair_inputs(spark, sf_dir), smooth=False)


@query("report_pair_ppmi")
def q_report_pair_ppmi(spark, sf_dir):
    return (ppmi.pair_ppmi(*pair_inputs(spark, sf_dir), smooth=True)
            .select("item_id", "score").orderBy("item_id"))


@query("src_pairs_vocab")
def q_src_pairs_vocab(spark, sf_dir):
    """The corpus pair table kept only where both words are in the
    lemma table and in the item vocabulary."""
    items, lem, pairs = pair_inputs(spark, sf_dir)
    return ppmi.pairs_in_vocab(pairs, lem, ppmi.item_vocab(items)).select("w1", "w2", "freq")


@query("item_vocab")
def q_item_vocab(spark, sf_dir):
    """Distinct words over all items."""
    s = cat.sents(spark, sf_dir)
    items = ppmi.pair_items(s.select(F.col("sent_id").alias("item_id"),
                                     tx.corpus_tokens(F.col("text")).alias("words")))
    return items.select(F.explode("words").alias("word")).distinct()


@query("report_ppmi")
def q_report_ppmi(spark, sf_dir):
    return ppmi.report_ppmi(cat.items_wide(spark, sf_dir), mapped_triples(spark, sf_dir))


@query("explain_ppmi")
def q_explain_ppmi(spark, sf_dir):
    return ppmi.explain_ppmi(cat.items_wide(spark, sf_dir), mapped_triples(spark, sf_dir))


# --------------------------------------------------------- text functions
@query("prep_sentence")
def q_prep_sentence(spark, sf_dir):
    s = cat.sents(spark, sf_dir).select("sent_id", tx.normalise_sentence(F.col("text")).alias("text"))
    return s.withColumn("valid", tx.sentence_valid(F.col("text")))


@query("word_count")
def q_word_count(spark, sf_dir):
    return cat.sents(spark, sf_dir).select("sent_id", tx.word_count(F.col("text")).alias("n_words"))


@query("strip_final_period")
def q_strip_final_period(spark, sf_dir):
    return cat.sents(spark, sf_dir).select("sent_id", tx.strip_final_periods(F.col("text")).alias("text"))


@query("target_word")
def q_target_word(spark, sf_dir):
    s = cat.sents(spark, sf_dir)
    return s.select("sent_id", tx.target_word(F.col("text"), F.col("word_pos")).alias("word"),
                    tx.target_word(F.col("text"), F.lit(-1)).alias("last_word"))


def _item_strings(spark, sf_dir):
    return cat.items_long(spark, sf_dir).select(
        "item_id", "slot", "n_slots", tx.item_string(F.col("lemma"), F.col("pos"), F.col("role")).alias("item"))


@query("parse_item")
def q_parse_item(spark, sf_dir):
    return _item_strings(spark, sf_dir).select("item_id", "slot", tx.parse_item(F.col("item")).alias("p")).select(
        "item_id", "slot", "p.lemma", "p.pos", "p.role", "p.base_role", "p.key")


@query("item_lemmas")
def q_item_lemmas(spark, sf_dir):
    return _item_strings(spark, sf_dir).select("item_id", "slot", tx.item_lemma(F.col("item")).alias("lemma"))


@query("role_prefix_match")
def q_role_prefix_match(spark, sf_dir):
    """which bigram roles a target role selects under ``startswith``.
    Both sides are distinct role labels (bounded by the label set); the
    prefix test is an equi-join on the exploded prefixes of each role."""
    items = cat.items_long(spark, sf_dir)
    targets = (items.where(F.col("slot") == F.col("n_slots") - 1)
               .select(F.substring_index("role", ":", 1).alias("target")).distinct())
    roles = cat.bigrams(spark, sf_dir).select(tx.role_of(F.col("a2")).alias("role")).distinct()
    prefixes = roles.select("role", F.explode(F.expr("transform(sequence(1, length(role)), i -> substr(role, 1, i))"))
                            .alias("target"))
    return prefixes.join(targets, "target").select("target", "role")


# ----------------------------------------------------------- thematic fit

TF_PARAMS = tf.TFParams(list_length=TF_LIST_LENGTH, n_centroid=TF_CENTROID_SIZE, weight=TF_WEIGHT, update=TF_UPDATE)
TF_SWEEP = [tf.TFParams(list_length=8, n_centroid=5, update="prod"),
            tf.TFParams(list_length=20, n_centroid=5, update="add"),
            tf.TFParams(list_length=200, n_centroid=20, update="prod")]


def tf_inputs(spark, sf_dir) -> tf.TFInputs:
    return cat.tf_inputs(spark, sf_dir)


def _protos(spark, sf_dir, p=TF_PARAMS):
    inp = tf_inputs(spark, sf_dir)
    return inp, tf.prototypes(inp, p, cat.tf_lists(spark, sf_dir, p.weight))


def _tfmodel(spark, sf_dir, p=TF_PARAMS):
    """Prototypes read from the written thematic-fit model (the operation
    and chosen fillers per context key)."""
    inp = tf_inputs(spark, sf_dir)
    model = cat.tf_model(spark, sf_dir, p)
    chosen = model.select("ctx_key", F.inline("chosen"))
    return inp, tf.with_model(inp, p, cat.tf_lists(spark, sf_dir, p.weight), model.select("ctx_key", "operation", "nl", "n_in_space"), chosen)


@query("attested_contexts")
def q_attested_contexts(spark, sf_dir):
    inp = tf_inputs(spark, sf_dir)
    keys = tf.distinct_keys(tf.item_keys(inp.items_wide))
    return tf.attested_contexts(keys, inp.bigrams).select("ctx_key", "li", "w")


@query("unattested_contexts")
def q_unattested_contexts(spark, sf_dir):
    inp = tf_inputs(spark, sf_dir)
    keys = tf.distinct_keys(tf.item_keys(inp.items_wide))
    return tf.unattested_contexts(keys, inp.bigrams).select("ctx_key", "t_role", "ci", "w")


@query("filler_retrieval")
def q_filler_retrieval(spark, sf_dir):
    _, pr = _protos(spark, sf_dir)
    return pr.lists


@query("filler_dropped")
def q_filler_dropped(spark, sf_dir):
    """How many probes and candidates the frequency table of lemmas from
    the minimum frequency on leaves out, observed while the lists are written."""
    inp = tf_inputs(spark, sf_dir)
    inp = replace(inp, lemma_pos_freqs=inp.lemma_pos_freqs.where(F.col("freq") >= LEMMA_POS_MIN_FREQ))
    seen = (Observation("probes"), Observation("candidates"))
    lists = tf.filler_lists(cat.tf_probes(spark, sf_dir), inp, TF_PARAMS, seen)
    lists.write.parquet(scratch_path(spark, "frequent_lists"))
    rows = [(o._name, int(o.get["seen"]), int(o.get["dropped"])) for o in seen]
    return spark.createDataFrame(rows, "what string, seen long, dropped long")


@query("filler_rank")
def q_filler_rank(spark, sf_dir):
    _, pr = _protos(spark, sf_dir)
    return tf.ranked(pr.lists)


@query("filler_top_n")
def q_filler_top_n(spark, sf_dir):
    """W2 + W3 from the impact-ordered blocks (best fillers by threshold)."""
    return sweep.dictionaries(cat.tf_ranked(spark, sf_dir, TF_PARAMS.weight), [TF_PARAMS]).select("w", "t_role", "filler", "weight")


@query("filler_intersection")
def q_filler_intersection(spark, sf_dir):
    _, pr = _protos(spark, sf_dir)
    return pr.updated.select("ctx_key", "filler")


@query("filler_update_prod")
def q_filler_update_prod(spark, sf_dir):
    _, pr = _protos(spark, sf_dir)
    return pr.updated


@query("filler_update_add")
def q_filler_update_add(spark, sf_dir):
    _, pr = _protos(spark, sf_dir, replace(TF_PARAMS, update="add"))
    return pr.updated


@query("prototype_fillers")
def q_prototype_fillers(spark, sf_dir):
    _, pr = _tfmodel(spark, sf_dir)
    return pr.chosen


@query("tf_operation")
def q_tf_operation(spark, sf_dir):
    _, pr = _tfmodel(spark, sf_dir)
    return pr.item_keys.select("item_id", "ctx_key").join(pr.ops, "ctx_key").select("item_id", "operation")


@query("prototype_centroid")
def q_prototype_centroid(spark, sf_dir):
    inp, pr = _tfmodel(spark, sf_dir)
    c = tf.centroids(pr, inp.vectors, TF_PARAMS)
    return c.select("ctx_key", "n_vecs", F.size("centroid").alias("dim"),
                    F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("c_sum"),
                    F.round(vx.norm(F.col("centroid")), 6).alias("c_norm"))


@query("cosine_pairs")
def q_cosine_pairs(spark, sf_dir):
    """P7 on every prototype filler: cosine of its vector and the centroid."""
    inp, pr = _tfmodel(spark, sf_dir)
    c = tf.centroids(pr, inp.vectors, TF_PARAMS)
    v = inp.vectors.select(F.col("word").alias("vkey"), "vec")
    j = (pr.chosen.withColumn("vkey", tf.filler_vkey(F.col("filler"), False)).join(v, "vkey")
         .join(c, "ctx_key"))
    return j.select("ctx_key", "r", F.round(vx.cosine(F.col("vec"), F.col("centroid")), 6).alias("cos"))


@query("tf_score")
def q_tf_score(spark, sf_dir):
    items = tf.item_keys(cat.items_wide(spark, sf_dir))
    return sweep.scores(items, cat.tf_model(spark, sf_dir, TF_PARAMS), cat.vectors(spark, sf_dir)).select("item_id", "score")


@query("tf_param_sweep")
def q_tf_param_sweep(spark, sf_dir):
    """Every setting from prefixes of the same ranked arrays, in one pass."""
    items = tf.item_keys(cat.items_wide(spark, sf_dir))
    model = written(cat.tf_models(spark, sf_dir, TF_SWEEP), "tf_models")
    cols = {k: F.element_at(F.array(*[F.lit(getattr(p, a)) for p in TF_SWEEP]), F.col("setting") + 1)
            for k, a in (("list_length", "list_length"), ("n_centroid", "n_centroid"), ("update_fn", "update"))}
    return sweep.scores(items, model, cat.vectors(spark, sf_dir)).select("item_id", *[c.alias(k) for k, c in cols.items()], "score")


@query("explain_prototype")
def q_explain_prototype(spark, sf_dir):
    _, pr = _tfmodel(spark, sf_dir)
    return tf.explain_prototype(pr)


@query("vec_key_lookup")
def q_vec_key_lookup(spark, sf_dir):
    inp = tf_inputs(spark, sf_dir)
    ik = tf.item_keys(inp.items_wide)
    words = inp.vectors.select(F.col("word").alias("vkey"), F.lit(True).alias("in_space"))
    return (ik.select("item_id", vx.vec_key(F.col("t_lemma"), F.col("t_pos"), False).alias("vkey"),
                      vx.vec_key(F.col("t_lemma"), F.col("t_pos"), True).alias("vkey_pos"))
            .join(words, "vkey", "left")
            .select("item_id", "vkey", "vkey_pos", F.coalesce("in_space", F.lit(False)).alias("in_space")))


@query("vec_key_lookup_pos")
def q_vec_key_lookup_pos(spark, sf_dir):
    """S11 in a space whose keys carry the part of speech: looked up by ``form/pos``."""
    inp = tf_inputs(spark, sf_dir)
    keyed = inp.vectors.select(F.concat("word", F.lit("/N")).alias("vkey_pos"), "vec")
    ik = tf.item_keys(inp.items_wide).select("item_id", vx.vec_key(F.col("t_lemma"), F.col("t_pos"), True).alias("vkey_pos"))
    return ik.join(keyed, "vkey_pos", "left").select("item_id", "vkey_pos", F.col("vec").isNotNull().alias("in_space"),
                                                      F.round(vx.norm(F.col("vec")), 6).alias("norm"))


@query("sdm_combine")
def q_sdm_combine(spark, sf_dir):
    inp, pr = _tfmodel(spark, sf_dir)
    return tf.sdm_scores(inp, TF_PARAMS, pr.lists, pr)


# ------------------------------------------------------------- LM scores


def _feats(spark, sf_dir):
    return cat.lm_feats(spark, sf_dir)


def _plan(spark, sf_dir, kind):
    return lm.mask_plan_for(cat.lm_sents(spark, sf_dir), kind)


def _token_scores(spark, sf_dir, kind):
    return lm.token_scores(_feats(spark, sf_dir), kind)


@query("word_groups_prefix")
def q_word_groups_prefix(spark, sf_dir):
    return tk.word_groups_prefix(tk.explode_tokens(cat.lm_sents(spark, sf_dir), "sent_id", "pcs"))


@query("word_groups_marker")
def q_word_groups_marker(spark, sf_dir):
    return tk.word_groups_marker(tk.explode_tokens(cat.lm_sents_marker(spark, sf_dir), "sent_id", "pcs"))


for _kind in ("plain", "l2r", "adapted"):
    QUERIES[f"mask_plan_{_kind}"] = (lambda k: lambda spark, sf_dir: _plan(spark, sf_dir, k).select(
        "sent_id", "target_pos", "mask_from", "mask_to"))(_kind)


@query("token_count")
def q_token_count(spark, sf_dir):
    n, n2 = tk.token_count(F.col("pcs"))
    return cat.lm_sents(spark, sf_dir).select("sent_id", n.alias("n_tokens"), n2.alias("n_with_markers"))


@query("locate_span")
def q_locate_span(spark, sf_dir):
    s = cat.lm_sents(spark, sf_dir)
    w = s.select("sent_id", "pcs", tk.pieces(tx.target_word(F.col("text"), F.col("word_pos")), "prefix").alias("wp"))
    return w.select("sent_id", tk.locate_span(F.col("pcs"), F.col("wp")).alias("start"), F.size("wp").alias("k"))


@query("span_score")
def q_span_score(spark, sf_dir):
    spans = q_locate_span(spark, sf_dir)
    s = tk.span_score(_token_scores(spark, sf_dir, "plain"), spans, average=False)
    return s.select("sent_id", F.round("score", 6).alias("score"))


@query("log_softmax_gather")
def q_log_softmax_gather(spark, sf_dir):
    """T8 over the corpus model: for every sentence piece, the candidates
    are the corpus continuations of its left neighbour with logit
    ln(count + 1); the piece's log-softmax is gathered (NULL when the
    corpus never continues the neighbour with it). The normaliser of every
    piece is one of the written tables."""
    feats = _feats(spark, sf_dir).select("sent_id", "pos", "prev", F.col("token").alias("target"))
    g = tk.log_softmax_gather(cat.continuation_logits(spark, sf_dir), feats.select("prev", "target").distinct(), ["prev"],
                              cat.lm_normaliser(spark, sf_dir))
    return (feats.join(g, ["prev", "target"], "left")
            .select("sent_id", "pos", F.round("logprob", 6).alias("logprob")))


@query("sentence_pll")
def q_sentence_pll(spark, sf_dir):
    return lm.sentence_scores(cat.lm_sents(spark, sf_dir), _token_scores(spark, sf_dir, "plain")).select(
        "sent_id", "score")


@query("length_normalise")
def q_length_normalise(spark, sf_dir):
    s = lm.sentence_scores(cat.lm_sents(spark, sf_dir), _token_scores(spark, sf_dir, "plain"))
    return s.select("sent_id", F.expr("stack(3, 'none', score, 'byNrTokens', score_by_tokens, "
                                      "'byNrWords', score_by_words) AS (norm, score)"))


@query("pll_plain")
def q_pll_plain(spark, sf_dir):
    return lm.sentence_scores(cat.lm_sents(spark, sf_dir), _token_scores(spark, sf_dir, "plain"))


@query("pll_l2r")
def q_pll_l2r(spark, sf_dir):
    return lm.sentence_scores(cat.lm_sents(spark, sf_dir), _token_scores(spark, sf_dir, "l2r"))


@query("pll_adapted")
def q_pll_adapted(spark, sf_dir):
    return lm.sentence_scores(cat.lm_sents(spark, sf_dir), _token_scores(spark, sf_dir, "adapted")).select(
        "sent_id", "text", "score", "n_tokens", "n_words")


@query("causal_ll")
def q_causal_ll(spark, sf_dir):
    return lm.causal_scores(cat.lm_sents(spark, sf_dir), _feats(spark, sf_dir), cat.piece_unigrams(spark, sf_dir))


@query("word_score_at")
def q_word_score_at(spark, sf_dir):
    return lm.word_scores(cat.lm_sents(spark, sf_dir), _token_scores(spark, sf_dir, "plain"), last=False)


@query("word_score_last")
def q_word_score_last(spark, sf_dir):
    return lm.word_scores(cat.lm_sents(spark, sf_dir), _token_scores(spark, sf_dir, "plain"), last=True)


@query("pll_adapted_marker")
def q_pll_adapted_marker(spark, sf_dir):
    """P11 with pieces in marker style (byte-level models): words are told by
    the marker of their first piece."""
    ts = lm.token_scores(cat.lm_feats_marker(spark, sf_dir), "adapted")
    return lm.sentence_scores(cat.lm_sents_marker(spark, sf_dir), ts).select("sent_id", "score", "n_tokens", "n_words")


@query("word_score_at_marker")
def q_word_score_at_marker(spark, sf_dir):
    """P13 with pieces in marker style: the word is looked up with the blank before it."""
    ts = lm.token_scores(cat.lm_feats_marker(spark, sf_dir), "plain")
    return lm.word_scores(cat.lm_sents_marker(spark, sf_dir), ts, style="marker")


@query("ngram_surprisal")
def q_ngram_surprisal(spark, sf_dir):
    surp = lm.surprisal_table(_feats(spark, sf_dir))
    return surp.withColumn("surprisal", F.round("surprisal", 6))


@query("sentence_surprisal")
def q_sentence_surprisal(spark, sf_dir):
    s = cat.lm_sents(spark, sf_dir)
    return lm.sentence_surprisal(s, lm.surprisal_table(_feats(spark, sf_dir)))


@query("surprisal_report")
def q_surprisal_report(spark, sf_dir):
    s = cat.lm_sents(spark, sf_dir)
    return lm.surprisal_report(s, lm.surprisal_table(_feats(spark, sf_dir)))


@query("score_with_udf")
def q_score_with_udf(spark, sf_dir):
    out = lm.score_with_udf(lm.sentence_features(_feats(spark, sf_dir)))
    return out.select("sent_id", "target_pos", F.round("logprob", 6).alias("logprob"))


@query("sentence_number")
def q_sentence_number(spark, sf_dir):
    return cnt.sentence_index(cat.sents(spark, sf_dir).select("sent_id"), ["sent_id"], "idx")


@query("dedupe_last")
def q_dedupe_last(spark, sf_dir):
    """W9 on raw repeated lines: triples written with their mapped role, one
    line per raw label in label order, so that keys repeat; of equal keys the
    last line of the files is kept."""
    path = scratch_path(spark, "dedupe_last")
    t = cat.triples_raw(spark, sf_dir).join(F.broadcast(cat.role_map(spark, sf_dir)), "raw_rel")
    rp.write_ordered(t, rp.tsv_line(F.col("head"), F.col("dep"), F.col("role"), F.col("freq")), ["head", "dep", "raw_rel"], path)
    c = F.split(F.col("line"), "\t")
    raw = rd.lines(spark, path).select(F.get(c, 0).alias("head"), F.get(c, 1).alias("dep"), F.get(c, 2).alias("role"),
                                       F.get(c, 3).cast("double").alias("freq"), "ord")
    return rk.dedupe_last(raw, ["head", "dep", "role"], ["freq"], "ord")


def _sentence_metrics(spark, sf_dir):
    """Per sentence and metric: the masked ones from one aggregate, and the causal one."""
    s = cat.lm_sents(spark, sf_dir)
    masked = lm.sentence_score_columns(s, _feats(spark, sf_dir), {"sentence-PLL": "adapted", "sentence-l2r-PLL": "l2r"})
    return masked, lm.causal_scores(s, _feats(spark, sf_dir), cat.piece_unigrams(spark, sf_dir)).withColumn("metric", F.lit("sentence-LL"))


@query("score_fanout")
def q_score_fanout(spark, sf_dir):
    """Every sentence under every metric and normalisation as one long
    table (an unpivot of per-sentence score columns - no cross join)."""
    masked, causal = _sentence_metrics(spark, sf_dir)
    return masked.unionByName(causal).select("sent_id", "metric", F.expr(
        "stack(3, '', score, 'average_byNrTokens', score_by_tokens, "
        "'average_byNrWords', score_by_words) AS (norm, score)"))


# ------------------------------------------------------ sources and sinks
# Each source key writes a view derived from the driver tables in the
# reference's text format into a fresh folder below the shared checkpoint
# folder, then reads it back with the reader under test.


@query("src_sentences")
def q_src_sentences(spark, sf_dir):
    path = scratch_path(spark, "src_sentences")
    s = cat.sents(spark, sf_dir)
    rp.write_lines(s, rp.tsv_line(F.col("sent_id"), F.col("text"), F.col("word_pos")), path)
    return rd.read_sentences(spark, path)


@query("src_role_items")
def q_src_role_items(spark, sf_dir):
    path = scratch_path(spark, "src_role_items")
    w = cat.items_wide(spark, sf_dir)
    line = F.concat_ws("\t", F.col("item_id").cast("string"),
                       F.array_join(F.transform("slots", lambda s: tx.item_string(s["lemma"], s["pos"], s["role"])), "\t"))
    rp.write_lines(w, line, path)
    return rd.read_role_items(spark, path)


def _role_file(spark, sf_dir) -> str:
    path = scratch_path(spark, "src_role_map")
    rm = cat.role_map(spark, sf_dir)
    by_role = rm.groupBy("role").agg(F.array_join(F.sort_array(F.collect_list("raw_rel")), ",").alias("raws"))
    rp.write_lines(by_role, F.concat_ws(" ", "role", "raws"), path)
    return path


@query("src_role_map")
def q_src_role_map(spark, sf_dir):
    return rd.read_role_map(spark, _role_file(spark, sf_dir))


@query("src_role_lists")
def q_src_role_lists(spark, sf_dir):
    """S3 forward: the raw labels of each role."""
    return rd.read_role_lists(spark, _role_file(spark, sf_dir)).select("role", F.array_join("raws", ",").alias("raws"), F.size("raws").alias("n"))


@query("src_triples_mapped")
def q_src_triples_mapped(spark, sf_dir):
    """S4 round trip: raw triples written as gzip text in (head, dep,
    raw_rel) order - so that the later of two lines mapped to one role is
    the one with the greater raw label - and read back with the relation
    map and the minimum frequency."""
    path = scratch_path(spark, "src_triples")
    t = cat.triples_raw(spark, sf_dir).orderBy("head", "dep", "raw_rel")
    rp.write_lines(t, F.concat(F.concat_ws(" ", "head", "dep", "raw_rel"), F.lit("\t"), F.col("freq").cast("string")),
                   path, compression="gzip")
    return rd.read_triples(spark, path, cat.role_map(spark, sf_dir), min_freq=float(TRIPLE_MIN))


@query("src_lemma_pos")
def q_src_lemma_pos(spark, sf_dir):
    path = scratch_path(spark, "src_lemma_pos")
    lp = cat.lemma_pos_freqs(spark, sf_dir)
    rp.write_lines(lp, F.concat(F.regexp_replace("lemma_pos", "@", " "), F.lit("\t"), F.col("freq").cast("string")),
                   path, compression="gzip")
    return rd.read_lemma_pos(spark, path)


@query("src_lemma_sum")
def q_src_lemma_sum(spark, sf_dir):
    """S6 round trip: per-document token counts (the same word on many
    lines) are summed back to corpus counts, with the grand total."""
    path = scratch_path(spark, "src_lemma_sum")
    per_doc = cat.toks(spark, sf_dir).groupBy("doc_id", "tok").agg(F.count(F.lit(1)).alias("c"))
    rp.write_lines(per_doc, F.concat(F.col("tok"), F.lit("\t"), F.col("c").cast("string")), path, compression="gzip")
    df = rd.read_lemma_sum(spark, path)
    return df.select(F.array_join("words", " ").alias("word"), "freq", "n_total")


@query("src_pair_sum")
def q_src_pair_sum(spark, sf_dir):
    """S6 with keys of two words: every pair on two lines, which are added."""
    path = scratch_path(spark, "src_pair_sum")
    halves = cat.pairs(spark, sf_dir).select("w1", "w2", F.explode(F.array(F.col("freq") - 2, F.lit(2.0))).alias("c"))
    rp.write_lines(halves, F.concat(F.concat_ws(" ", "w1", "w2"), F.lit("\t"), F.col("c").cast("string")), path, compression="gzip")
    return rd.read_lemma_sum(spark, path).select(F.get("words", F.lit(0)).alias("w1"), F.get("words", F.lit(1)).alias("w2"), "freq", "n_total")


def raw_bigrams(spark, sf_dir):
    """Bigrams with raw relation labels (before mapping): subject-verb for
    subject labels and verb-filler for the others."""
    b = fx.base_counts(spark, sf_dir)
    subj = b.where(F.col("raw_rel").startswith("R")).select(
        F.concat_ws("@", "subj", F.lit("N"), "raw_rel").alias("x1"),
        F.concat_ws("@", "verb", F.lit("V"), F.lit(fx.HEAD_LABEL)).alias("x2"), "cnt")
    fill = b.where(~F.col("raw_rel").startswith("R")).select(
        F.concat_ws("@", "verb", F.lit("V"), F.lit(fx.HEAD_LABEL)).alias("x1"),
        F.concat_ws("@", "filler", F.lit("N"), "raw_rel").alias("x2"), "cnt")
    return subj.unionByName(fill).groupBy("x1", "x2").agg(F.sum("cnt").cast("double").alias("freq"))


@query("src_bigrams_mapped")
def q_src_bigrams_mapped(spark, sf_dir):
    path = scratch_path(spark, "src_bigrams")
    rb = raw_bigrams(spark, sf_dir).orderBy("x1", "x2")
    rp.write_lines(rb, F.concat(F.concat_ws(" ", "x1", "x2"), F.lit("\t"), F.col("freq").cast("string")),
                   path, compression="gzip")
    return rd.read_bigrams(spark, path, cat.role_map(spark, sf_dir))


VEC_K = 32


def _vector_file(spark, sf_dir) -> str:
    """The vector space as ``.vec`` text with its header ``n dim``."""
    path = scratch_path(spark, "src_vectors")
    v = cat.vectors(spark, sf_dir)
    body = v.select(F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))
                    .alias("value"))
    head = v.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.max(F.size("vec")).cast("string")).alias("value"))
    rp.write_lines(head.unionByName(body), F.col("value"), path)
    return path


def _vector_digest(df: DataFrame) -> DataFrame:
    return df.select("word", F.size("vec").alias("dim"),
                     F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("v_sum"),
                     F.round(F.element_at("vec", 1), 6).alias("v_first"))


@query("src_vectors")
def q_src_vectors(spark, sf_dir):
    """S10 round trip: the vector space as text, read back restricted to the
    item vocabulary and truncated to the last ``VEC_K`` dimensions (the text
    loader's truncation)."""
    vocab = cat.items_long(spark, sf_dir).select(F.col("lemma").alias("word")).distinct()
    return _vector_digest(rd.read_vectors(spark, _vector_file(spark, sf_dir), vocab=vocab, k=VEC_K, from_end=True))


@query("src_vectors_full")
def q_src_vectors_full(spark, sf_dir):
    """S10 without a vocabulary or a truncation."""
    return _vector_digest(rd.read_vectors(spark, _vector_file(spark, sf_dir)))


@query("src_vectors_first")
def q_src_vectors_first(spark, sf_dir):
    """S10 truncated to the first ``VEC_K`` dimensions."""
    return _vector_digest(rd.read_vectors(spark, _vector_file(spark, sf_dir), k=VEC_K))


@query("src_surprisal")
def q_src_surprisal(spark, sf_dir):
    """S12 round trip: the U2 surprisal table as TSV with a header plus a
    trailing terminal-escape line, read back typed."""
    path = scratch_path(spark, "src_surprisal")
    surp = lm.surprisal_table(_feats(spark, sf_dir))
    cols = ["sentence_id", "token_id", "token", "surprisal"]
    rows = surp.select(*[F.col(c).cast("string").alias(c) for c in cols])
    # the terminal escape line the reference's surprisal files end with
    junk = surp.agg(F.lit("\u001b[0m").alias("sentence_id"),
                    *[F.lit(None).cast("string").alias(c) for c in cols[1:]])
    (rows.unionByName(junk).write.mode("overwrite").option("sep", "\t").option("header", "true")
     .option("quote", "").csv(path))
    return rd.read_surprisal(spark, path).withColumn("surprisal", F.round("surprisal", 6))


def original_dataset(spark, sf_dir):
    """The original dataset of the items: text, a plausibility label taken
    from the order status, and ``lemma:rel`` dependencies."""
    w = cat.items_wide(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), "o_orderstatus")
    return w.join(o, "item_id").select(
        "item_id", F.array_join(F.transform("slots", lambda s: s["lemma"]), " ").alias("text"),
        F.when(F.col("o_orderstatus") == "F", "Plausible").otherwise("Implausible").alias("label"),
        F.concat(F.array_join(F.transform("slots", lambda s: F.concat(s["lemma"], F.lit(":"), F.lower(s["role"]))), " "),
                 F.lit(" ")).alias("deps"))


@query("join_original")
def q_join_original(spark, sf_dir):
    """S13 + J11: the original dataset written with CRLF line ends, read
    back and joined to the syntax PPMI scores by id."""
    path = scratch_path(spark, "src_original")
    od = original_dataset(spark, sf_dir)
    rp.write_lines(od, F.concat_ws("\t", F.col("item_id").cast("string"), "text", "label", "deps"), path,
                   line_sep="\r\n")
    back = rd.read_original(spark, path)
    sc = ppmi.ppmi_syntax(cat.items_wide(spark, sf_dir), mapped_triples(spark, sf_dir))
    return back.join(sc.select("item_id", "score"), "item_id").select("item_id", "text", "label", "deps", "score")


def _score_matrix(spark, sf_dir):
    masked, causal = _sentence_metrics(spark, sf_dir)
    return masked.unionByName(causal).select(
        F.lit("sents").alias("dataset"), F.lit("bigram").alias("model"), "metric", F.col("sent_id").alias("id"), "text",
        F.expr("stack(3, 'none', score, 'average_byNrTokens', score_by_tokens, "
               "'average_byNrWords', score_by_words) AS (norm, score)"), "n_tokens", "n_words")


@query("report_sentence_scores")
def q_report_sentence_scores(spark, sf_dir):
    """K1 written partitioned by dataset/model/metric/norm, read back by
    S14."""
    path = scratch_path(spark, "report_sentence_scores")
    rp.write_sentence_scores(_score_matrix(spark, sf_dir), path)
    return rd.read_score_matrix(spark, path).drop("text")


def _word_score_table(spark, sf_dir):
    s = cat.lm_sents(spark, sf_dir)
    ts = _token_scores(spark, sf_dir, "plain")
    parts = []
    for metric, last in (("verb-PLL", False), ("last-word-PLL", True)):
        ws = lm.word_scores(s, ts, last=last)
        parts.append(s.select("sent_id", "text").join(ws, "sent_id").select(
            F.lit("sents").alias("dataset"), F.lit("bigram").alias("model"), F.lit(metric).alias("metric"),
            F.lit("none").alias("norm"), F.col("sent_id").alias("id"), "text", "score"))
    return parts[0].unionByName(parts[1])


@query("report_word_scores")
def q_report_word_scores(spark, sf_dir):
    """K2: 3-column word score files, read back by S14."""
    path = scratch_path(spark, "report_word_scores")
    rp.write_word_scores(_word_score_table(spark, sf_dir), path)
    return rd.read_score_matrix(spark, path).select("metric", "id", "text", "score", "n_tokens")


def _score_tree(spark, sf_dir) -> str:
    path = scratch_path(spark, "score_matrix")
    rp.write_sentence_scores(_score_matrix(spark, sf_dir), path)
    rp.write_word_scores(_word_score_table(spark, sf_dir), path, mode="append")
    return path


@query("src_score_matrix")
def q_src_score_matrix(spark, sf_dir):
    """5-column sentence files and 3-column word files in one folder
    tree, read as one table."""
    return rd.read_score_matrix(spark, _score_tree(spark, sf_dir)).drop("text")


@query("src_score_matrix_pruned")
def q_src_score_matrix_pruned(spark, sf_dir):
    """One metric and normalisation; the other folders are not read."""
    return rd.read_score_matrix(spark, _score_tree(spark, sf_dir)).where(
        (F.col("metric") == "sentence-l2r-PLL") & (F.col("norm") == "average_byNrWords")).drop("text")


@query("src_score_matrix_files")
def q_src_score_matrix_files(spark, sf_dir):
    """Files named ``dataset.model.metric[.norm].txt``."""
    path = scratch_path(spark, "score_files")
    words, sentences = _word_score_table(spark, sf_dir), _score_matrix(spark, sf_dir)
    rp.write_lines(words.where("metric = 'verb-PLL'"), rp.tsv_line(F.col("id"), F.col("text"), F.col("score")), f"{path}/sents.bigram.verb-PLL.txt")
    for norm in ("none", "average_byNrTokens"):
        named = f"{path}/sents.bigram.sentence-PLL{'' if norm == 'none' else '.' + norm}.txt"
        one = sentences.where((F.col("metric") == "sentence-PLL") & (F.col("norm") == norm))
        rp.write_lines(one, rp.tsv_line(F.col("id"), F.col("text"), F.col("score"), F.col("n_tokens"), F.col("n_words")), named)
    return rd.read_score_matrix(spark, f"{path}/*.txt").drop("text")


# ------------------------------------------------- K3-K7 as ordered files


def _ordered_report(spark, name: str, df: DataFrame, line, keys: list[str]) -> DataFrame:
    path = scratch_path(spark, name)
    rp.write_ordered(df, line, keys, path)
    return rd.read_numbered_lines(spark, path)


def _six(c) -> F.Column:
    return F.format_string("%.6f", c + F.lit(0.0))


@query("report_ppmi_file")
def q_report_ppmi_file(spark, sf_dir):
    """K3 written in id order: ``id, text, parts, score``."""
    rep = ppmi.report_ppmi(cat.items_wide(spark, sf_dir), mapped_triples(spark, sf_dir))
    return _ordered_report(spark, "report_ppmi", rep, rp.tsv_line(F.col("item_id"), F.col("text"), F.col("parts"), _six(F.col("score"))), ["item_id"])


@query("explain_ppmi_file")
def q_explain_ppmi_file(spark, sf_dir):
    """K4 written in id order: ``id components flag``, parted by blanks."""
    rep = ppmi.explain_ppmi(cat.items_wide(spark, sf_dir), mapped_triples(spark, sf_dir))
    return _ordered_report(spark, "explain_ppmi", rep, F.concat_ws(" ", F.col("item_id").cast("string"), "log", "flag"), ["item_id"])


@query("report_pair_ppmi_file")
def q_report_pair_ppmi_file(spark, sf_dir):
    """K5 written in id order: ``id, score``."""
    rep = QUERIES["pair_ppmi"](spark, sf_dir)
    return _ordered_report(spark, "report_pair_ppmi", rep, rp.tsv_line(F.col("item_id"), _six(F.col("score"))), ["item_id"])


@query("report_tf_file")
def q_report_tf_file(spark, sf_dir):
    """K6 written in id order: ``id, sentence, score``; a target without a
    vector prints ``None``."""
    text = original_dataset(spark, sf_dir).select("item_id", "text")
    rep = text.join(QUERIES["tf_score"](spark, sf_dir), "item_id")
    score = F.when(F.col("score").isNotNull(), _six(F.col("score")))
    return _ordered_report(spark, "report_tf", rep, rp.tsv_line(F.col("item_id"), F.col("text"), score), ["item_id"])


@query("explain_tf_file")
def q_explain_tf_file(spark, sf_dir):
    """K7 written in id order: ``id, contexts..., target, fillers, operation``."""
    _, pr = _tfmodel(spark, sf_dir)
    slots = F.transform("slots", lambda s: tx.item_string(s["lemma"], s["pos"], s["role"]))
    items = cat.items_wide(spark, sf_dir).select("item_id", F.array_join(slots, "\t").alias("slots"))
    rep = items.hint("merge").join(tf.explain_prototype(pr), "item_id")  # the items' files are small, their rows are not
    return _ordered_report(spark, "explain_tf", rep, rp.tsv_line(F.col("item_id"), F.col("slots"), F.col("fillers"), F.col("operation")), ["item_id"])


@query("report_surprisal")
def q_report_surprisal(spark, sf_dir):
    """K8: the surprisal report with a running 0-based index, written as
    TSV and read back."""
    path = scratch_path(spark, "report_surprisal")
    s = cat.lm_sents(spark, sf_dir)
    rep = lm.surprisal_report(s, lm.surprisal_table(_feats(spark, sf_dir)))
    rep = cnt.sentence_index(rep, ["sent_id"], "idx")
    rp.write_surprisal_report(rep, path)
    c = F.split(F.col("value"), "\t")
    return spark.read.text(path).select(F.get(c, 0).cast("long").alias("idx"), F.get(c, 1).alias("text"),
                                        F.get(c, 2).cast("double").alias("surprisal"), F.get(c, 3).alias("sentence"),
                                        F.get(c, 4).alias("unk"))


@query("report_sentences")
def q_report_sentences(spark, sf_dir):
    """K9: prepared sentences, one per line."""
    path = scratch_path(spark, "report_sentences")
    rp.write_sentences(cat.lm_sents(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("text"))


@query("unk_flag")
def q_unk_flag(spark, sf_dir):
    """F10 on the model's tokens of every sentence."""
    s = cat.lm_sents(spark, sf_dir)
    rep = lm.surprisal_report(s, lm.surprisal_table(_feats(spark, sf_dir)))
    return rep.select("sent_id", "unk")


@query("rejoin_tokens")
def q_rejoin_tokens(spark, sf_dir):
    """the model's tokens of every sentence joined in token order."""
    surp = lm.surprisal_table(_feats(spark, sf_dir))
    return surp.groupBy(F.col("sentence_id").alias("sent_id")).agg(
        tx.rejoin_tokens(F.collect_list(F.struct("token_id", "token"))).alias("sentence"))
