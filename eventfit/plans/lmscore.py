"""Language-model sentence scores.

The neural models of the reference are a black box from a masked (or
causal) sentence to a per-token log-probability. Here that box is a
DataFrame boundary ``(sent_id, target_pos, logprob)`` with two providers:

* U2: an add-one smoothed piece-bigram model counted by Spark over the whole
  ``documents`` corpus. A masked target is scored from its left neighbour
  (always visible in all three mask plans) plus, when the right neighbour is
  visible in that variant, the association of target and right neighbour
  (``ln p(next | target) - ln p(next)``) - so plain, left-to-right and
  adapted masking give different scores, as they do with a real model.
* U1: any user function applied to Arrow batches of whole sentences, with
  the masked range of every target (``mapInPandas``), e.g. a real model's
  batch inference.

Everything downstream - sums, length normalisation, spans, surprisal
reports - is plain DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import UNK_MARK, WORD_MARKER
from ..functions import text as tx
from ..operators import tokens as tk
from ..operators.ranking import dense_index, with_scalars
from ..session import scratch_path
from .batching import BATCH_TOKENS, corpus_model, runner
from .batching import mask_ends as mask_ends

BOS = "<s>"


# ------------------------------------------------------------ the corpus model
def corpus_piece_bigrams(docs: DataFrame, style: str = "prefix") -> DataFrame:
    """U2 counts, one pass over the corpus: ``(prev, w, c)`` adjacent-piece
    bigrams, the first piece of a document following ``<s>``.

    Adjacent pairs are zipped inside each document row, so counting is an
    explode plus a partial aggregate - no self join, no window over a
    document. The rows without pieces are dropped behind the explode: a
    condition on the pieces before it would cut every text once more."""
    p = docs.select(tk.pieces(F.col("text"), style).alias("pcs"))
    seq = F.concat(F.array(F.lit(BOS)), F.col("pcs"))
    pairs = F.arrays_zip(F.slice(seq, 1, F.size("pcs")).alias("prev"), F.col("pcs").alias("w"))
    return (p.select(F.explode_outer(pairs).alias("z")).where(F.col("z.w").isNotNull())
            .groupBy(F.col("z.prev").alias("prev"), F.col("z.w").alias("w"))
            .agg(F.count(F.lit(1)).cast("double").alias("c")))


def corpus_piece_unigrams(bigrams: DataFrame, docs: DataFrame) -> DataFrame:
    """``(w, c)``: every piece occurrence has exactly one predecessor, so a
    piece's count is the sum of its bigram counts; ``<s>`` occurs once per
    document. No second pass over the text."""
    u = bigrams.groupBy("w").agg(F.sum("c").alias("c"))
    return u.unionByName(docs.agg(F.count(F.lit(1)).cast("double").alias("c")).select(F.lit(BOS).alias("w"), "c"))


def corpus_piece_counts(docs: DataFrame, style: str = "prefix") -> tuple[DataFrame, DataFrame]:
    """``(unigrams, bigrams)`` of the piece model."""
    bi = corpus_piece_bigrams(docs, style)
    return corpus_piece_unigrams(bi, docs), bi


def lm_sentences(sents: DataFrame, style: str = "prefix") -> DataFrame:
    """``(sent_id, text, word_pos, n_words, pcs)``: the prepared sentence
    (F1), its whitespace word count (F2) and its pieces."""
    t = tx.normalise_sentence(F.col("text"))
    return sents.select("sent_id", t.alias("text"), "word_pos", tx.word_count(t).alias("n_words"),
                        tk.pieces(t, style).alias("pcs"))


def neighbours(pcs):
    """``array<struct<prev, token, nxt>>``: every piece with its left
    neighbour (``<s>`` first) and right neighbour (NULL last), built by
    zipping shifted copies of the array. (Exploding the array while carrying
    the array itself on every output row would copy it once per piece -
    quadratic in the sentence length.)"""
    n = F.size(pcs)
    seq = F.concat(F.array(F.lit(BOS)), pcs)
    return F.arrays_zip(F.slice(seq, 1, n).alias("prev"), pcs.alias("token"),
                        F.slice(pcs, 2, F.greatest(n - 1, F.lit(0))).alias("nxt"))


def sentence_tokens(sent: DataFrame) -> DataFrame:
    """``(sent_id, n, pos, token, prev, nxt)``: every piece with its neighbours; ``nxt`` is '' at the end."""
    t = sent.select("sent_id", F.size("pcs").alias("n"), F.posexplode(neighbours(F.col("pcs"))).alias("p0", "z"))
    return t.select("sent_id", "n", (F.col("p0") + 1).alias("pos"), F.col("z.token").alias("token"),
                    F.col("z.prev").alias("prev"), F.coalesce("z.nxt", F.lit("")).alias("nxt"))


def context_table(tokens: DataFrame, uni: DataFrame, bi: DataFrame) -> DataFrame:
    """One row per distinct ``(prev, token, nxt)`` with its natural-log add-one
    probabilities ``left_bi, uni, right_gain`` and the piece's count.

    Text repeats itself, so there are far fewer of these than tokens. Their
    pieces are numbered by the unigram table and the bigrams looked up by two
    integers packed into one; unknown pieces have no number.

    All tables grow with the corpus: the hints keep the planner from sending one
    whole through the driver because its files are small."""
    tot = uni.agg(F.sum("c").alias("n_total"), F.count(F.lit(1)).cast("double").alias("v_size"))
    ids = written_ids(uni)
    pack = lambda a, b: F.shiftleft(F.col(a), 32).bitwiseOR(F.col(b))
    by = lambda name: ids.select(F.col("w").alias(name), F.col("k").alias(f"k_{name}"), F.col("c").alias(f"c_{name}")).hint("merge")
    pairs = bi.join(by("prev"), "prev").join(ids.select("w", F.col("k").alias("k_w")).hint("merge"), "w").select(pack("k_prev", "k_w").alias("pair"), "c")
    j = tokens.select("prev", "token", "nxt").distinct()
    for name in ("prev", "token", "nxt"):
        j = j.join(by(name), name, "left")
    j = j.withColumns({"left_pair": pack("k_prev", "k_token"), "right_pair": pack("k_token", "k_nxt")})
    j = j.join(pairs.select(F.col("pair").alias("left_pair"), F.col("c").alias("c_pt")).hint("merge"), "left_pair", "left") \
         .join(pairs.select(F.col("pair").alias("right_pair"), F.col("c").alias("c_tn")).hint("merge"), "right_pair", "left")
    j = with_scalars(j, tot)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    left_bi = F.log((z("c_pt") + 1) / (z("c_prev") + F.col("v_size")))
    unigram = F.log((z("c_token") + 1) / (F.col("n_total") + F.col("v_size")))
    right = F.when(F.col("nxt") != "", F.log((z("c_tn") + 1) / (z("c_token") + F.col("v_size")))
                   - F.log((z("c_nxt") + 1) / (F.col("n_total") + F.col("v_size"))))
    return j.select("prev", "token", "nxt", left_bi.alias("left_bi"), unigram.alias("uni"), right.alias("right_gain"), z("c_token").alias("c_token"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"lm/{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_ids(uni: DataFrame) -> DataFrame:
    """``(w, c, k)``: the pieces of the unigram table with a number each, written."""
    k = dense_index(uni.select("w"), "w")
    return _stored(uni.join(k.hint("merge"), "w"), "piece_ids")


def token_features(sent: DataFrame, contexts: DataFrame, style: str = "prefix") -> DataFrame:
    """Per sentence piece ``(sent_id, pos, token, n, word_end, prev, nxt, left_bi,
    uni, right_gain, c_token)``: log add-one probabilities from the corpus
    model, and what the mask ranges need (``n``, ``word_end``).

    One join on the token rows, with the (written) table of their distinct
    contexts, so that a frequent context can be split."""
    j = tk.word_ends(sentence_tokens(sent).join(contexts.hint("merge"), ["prev", "token", "nxt"]), style)
    return j.select("sent_id", "pos", "token", "n", "word_end", "prev", F.nullif("nxt", F.lit("")).alias("nxt"),
                    "left_bi", "uni", "right_gain", "c_token")


def pair_table(tokens: DataFrame, uni: DataFrame, bi: DataFrame) -> DataFrame:
    """One row per distinct ``(prev, token)`` with the counts ``c_pt, c_token``
    (0 where the corpus has none). The counts of a sentence's left and right
    neighbours need no columns of their own: they stand in the rows of these."""
    counts = uni.select(F.col("w").alias("token"), F.col("c").alias("c_token")).hint("merge")
    seen = bi.select("prev", F.col("w").alias("token"), F.col("c").alias("c_pt")).hint("merge")
    j = tokens.select("prev", "token").distinct().join(seen, ["prev", "token"], "left").join(counts, "token", "left")
    return j.select("prev", "token", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("c_pt", "c_token")])


def pair_features(sent: DataFrame, pairs: DataFrame, uni: DataFrame, style: str = "prefix", parts: int | None = None) -> DataFrame:
    """The rows of ``token_features`` from the (written) ``pair_table``.

    Token rows are joined once and then gathered by sentence (``sent_id`` tells
    sentences apart), where the window that finds the ends of words also takes
    the neighbours and their counts, so that a token travels with its own two
    counts only. With ``parts`` they are gathered in so many tasks: left to the
    planner, these are as few as their packed bytes allow, and the rows don't
    fit for sorting."""
    tot = uni.agg(F.sum("c").alias("n_total"), F.count(F.lit(1)).cast("double").alias("v_size"),
                  F.coalesce(F.max(F.when(F.col("w") == BOS, F.col("c"))), F.lit(0.0)).alias("c_bos"))
    j = sentence_tokens(sent).select("sent_id", "pos", "prev", "token").join(pairs.hint("merge"), ["prev", "token"])
    j = j.select("sent_id", "pos", "token", "c_pt", "c_token")
    j = j.repartition(parts, "sent_id") if parts else j
    after = Window.partitionBy("sent_id").orderBy(F.col("pos").desc())
    j = j.withColumns({"n": F.first("pos").over(after.rowsBetween(Window.unboundedPreceding, 0)),
                       "prev": F.lead("token", 1, BOS).over(after), "c_prev": F.lead("c_token").over(after),
                       **{n: F.lag(c).over(after) for n, c in (("nxt", "token"), ("c_tn", "c_pt"), ("c_nxt", "c_token"))}})
    j = with_scalars(tk.word_ends(j, style), tot).withColumn("c_prev", F.coalesce("c_prev", "c_bos"))
    unigram = lambda c: F.log((F.col(c) + 1) / (F.col("n_total") + F.col("v_size")))
    bigram = lambda c, left: F.log((F.col(c) + 1) / (F.col(left) + F.col("v_size")))
    return j.select("sent_id", "pos", "token", "n", "word_end", "prev", "nxt", bigram("c_pt", "c_prev").alias("left_bi"),
                    unigram("c_token").alias("uni"), (bigram("c_tn", "c_token") - unigram("c_nxt")).alias("right_gain"), "c_token")


def corpus_features(sent: DataFrame, uni: DataFrame, bi: DataFrame, style: str = "prefix") -> DataFrame:
    """``pair_features`` with the pair table made and written on the way."""
    return pair_features(sent, _stored(pair_table(sentence_tokens(sent), uni, bi), "pairs"), uni, style)


def target_logprob(kind: str) -> F.Column:
    """U2 over feature rows: the target's log-probability under a mask plan.
    Masked is ``pos .. mask_range_end``, so the left neighbour is always
    visible and the right one beyond the range."""
    visible = (F.col("pos") + 1 > tk.mask_range_end(kind)) & F.col("right_gain").isNotNull()
    return F.col("left_bi") + F.when(visible, F.col("right_gain")).otherwise(F.lit(0.0))


def token_scores(feats: DataFrame, kind: str) -> DataFrame:
    """``(sent_id, target_pos, logprob)``: the features already hold all that a
    mask plan needs, so there is neither a join nor a shuffle."""
    return feats.select("sent_id", F.col("pos").alias("target_pos"), target_logprob(kind).alias("logprob"))


def sentence_features(feats: DataFrame) -> DataFrame:
    """One row per sentence ``(sent_id, pcs, left_bi, right_gain)``, the arrays
    in the order of its pieces: the input of ``corpus_model``."""
    cols = ["token", "left_bi", "right_gain"]
    g = feats.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("pos", *cols))).alias("z"))
    return g.select("sent_id", F.col("z.token").alias("pcs"), "z.left_bi", "z.right_gain")


def score_with_udf(sent: DataFrame, fn: Callable[[pd.DataFrame], list] = corpus_model, kind: str = "plain",
                   style: str = "prefix", batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """The batch-inference hook, ``(sent_id, target_pos, logprob)``.

    ``sent`` has one row per sentence: ``sent_id``, its pieces ``pcs`` and any
    columns the model wants. ``fn`` receives a batch of them as pandas with
    ``mask_from`` and ``mask_to`` added (for each target asked for the masked
    range, 1-based) and returns for each row the log-probabilities of its
    targets. A row always holds its whole sentence. Targets times the longest
    sentence of a batch are at most ``batch_tokens``; partitions are sorted by
    length, so that batches need little padding, and nothing is shuffled.
    Sentences without pieces give no rows."""
    return sent.sortWithinPartitions(F.size("pcs")).mapInPandas(
        runner(fn, kind, style, batch_tokens), "sent_id long, target_pos int, logprob double")


# ------------------------------------------------------------------ plans
def mask_plan_for(sent: DataFrame, kind: str, style: str = "prefix") -> DataFrame:
    toks = sent.select("sent_id", F.size("pcs").alias("n"), F.posexplode("pcs").alias("p0", "token")) \
        .select("sent_id", "n", (F.col("p0") + 1).alias("pos"), "token")
    if kind == "adapted":
        toks = tk.word_groups_prefix(toks) if style == "prefix" else tk.word_groups_marker(toks)
    return tk.mask_plan(toks, kind)


def sentence_scores(sent: DataFrame, token_scores: DataFrame) -> DataFrame:
    """A1 + A2: ``(sent_id, text, score, score_by_tokens, score_by_words,
    n_tokens, n_words)``; sentences without pieces score 0."""
    s = token_scores.groupBy("sent_id").agg(F.sum("logprob").alias("score"))
    j = sent.select("sent_id", "text", F.size("pcs").alias("n_tokens"), "n_words").join(s.hint("merge"), "sent_id", "left")
    sc = F.coalesce(F.col("score"), F.lit(0.0))
    return j.select("sent_id", "text", F.round(sc, 6).alias("score"),
                    F.round(F.try_divide(sc, F.col("n_tokens")), 6).alias("score_by_tokens"),
                    F.round(F.try_divide(sc, F.col("n_words")), 6).alias("score_by_words"),
                    "n_tokens", "n_words")


def sentence_score_columns(sent: DataFrame, feats: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``(sent_id, text, metric, score, score_by_tokens, score_by_words,
    n_tokens, n_words)`` for several mask plans (metric name -> plan): all sums
    of a sentence come from one aggregate over its features."""
    g = feats.groupBy("sent_id").agg(*[F.sum(target_logprob(kind)).alias(f"s_{i}") for i, kind in enumerate(kinds.values())])
    j = sent.select("sent_id", "text", F.size("pcs").alias("n_tokens"), "n_words").join(g.hint("merge"), "sent_id", "left")
    per = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(f"s_{i}", F.lit(0.0)).alias("s")) for i, m in enumerate(kinds)])
    j = j.select("sent_id", "text", "n_tokens", "n_words", F.inline(per))
    return j.select("sent_id", "text", "metric", F.round("s", 6).alias("score"),
                    F.round(F.try_divide("s", "n_tokens"), 6).alias("score_by_tokens"),
                    F.round(F.try_divide("s", "n_words"), 6).alias("score_by_words"), "n_tokens", "n_words")


def causal_scores(sent: DataFrame, feats: DataFrame, uni: DataFrame, exact: bool = False) -> DataFrame:
    """A3: sequence ``<s> pieces <s>``; n counts both markers, the mean
    log-probability covers the n-1 predictions; score = mean * n (or the
    exact sum with ``exact=True``), per token = mean, per word = mean * n /
    words.

    All predictions but the last are the features' ``left_bi``; the corpus
    never continues a piece with the marker, so the last one needs only the
    count of the sentence's last piece. No token row is joined again."""
    tot = uni.agg(F.count(F.lit(1)).cast("double").alias("v_size"),
                  F.coalesce(F.max(F.when(F.col("w") == BOS, F.col("c"))), F.lit(0.0)).alias("c_bos"))
    g = feats.groupBy("sent_id").agg(F.sum("left_bi").alias("s"), F.max_by("c_token", "pos").alias("c_last"))
    j = sent.select("sent_id", "text", (F.size("pcs") + 2).alias("n_tokens"), "n_words").join(g.hint("merge"), "sent_id", "left")
    j = with_scalars(j, tot)
    total = F.coalesce("s", F.lit(0.0)) - F.log(F.coalesce("c_last", "c_bos") + F.col("v_size"))
    j = j.withColumns({"sum_lp": total, "mean_lp": total / (F.col("n_tokens") - 1)})
    score = F.col("sum_lp") if exact else F.col("mean_lp") * F.col("n_tokens")
    return j.select("sent_id", "text", F.round(score, 6).alias("score"),
                    F.round(F.col("mean_lp"), 6).alias("score_by_tokens"),
                    F.round(F.try_divide(score, F.col("n_words")), 6).alias("score_by_words"),
                    "n_tokens", "n_words")


def surprisal_table(feats: DataFrame) -> DataFrame:
    """U2 as a token surprisal file: ``(sentence_id, token_id, token,
    surprisal)`` with ``-log2 p(piece | previous piece)``, 1-based ids;
    pieces never seen in the corpus are written ``UNK``. A projection of the
    features."""
    tok = F.when(F.col("c_token") == 0, F.lit(UNK_MARK)).otherwise(F.col("token"))
    return feats.select(F.col("sent_id").alias("sentence_id"), F.col("pos").cast("int").alias("token_id"), tok.alias("token"),
                        (-F.col("left_bi") / F.log(F.lit(2.0))).alias("surprisal"))


def sentence_surprisal(sent: DataFrame, surp: DataFrame) -> DataFrame:
    """A4: sum per sentence; sentences without rows keep 0."""
    s = surp.groupBy("sentence_id").agg(F.sum("surprisal").alias("surprisal"))
    return (sent.select("sent_id").join(s.withColumnRenamed("sentence_id", "sent_id").hint("merge"), "sent_id", "left")
            .select("sent_id", F.round(F.coalesce("surprisal", F.lit(0.0)), 6).alias("surprisal")))


def surprisal_report(sent: DataFrame, surp: DataFrame) -> DataFrame:
    """``(sent_id, text, surprisal, sentence, unk)``: the summed
    surprisal, the model's tokens joined in order (F11) and the unknown-word
    flag (F10)."""
    g = surp.groupBy("sentence_id").agg(
        F.sum("surprisal").alias("surprisal"),
        tx.rejoin_tokens(F.collect_list(F.struct(F.col("token_id"), F.col("token")))).alias("sentence"))
    j = sent.select("sent_id", "text").join(g.withColumnRenamed("sentence_id", "sent_id").hint("merge"), "sent_id", "left")
    sentence = F.coalesce("sentence", F.lit(""))
    return j.select("sent_id", "text", F.round(F.coalesce("surprisal", F.lit(0.0)), 6).alias("surprisal"),
                    sentence.alias("sentence"), tx.unk_flag(sentence).alias("unk"))


def word_scores(sent: DataFrame, token_scores: DataFrame, last: bool = False, style: str = "prefix",
                last_occurrence: bool = False) -> DataFrame:
    """Mean log-probability of the pieces of the target word (the word
    at ``word_pos``, or the last word), located by T6, summed by T7. As in
    the reference the first occurrence of the word is used, also for the
    last word; ``last_occurrence=True`` uses the last one."""
    pos = F.lit(-1) if last else F.col("word_pos")
    w = sent.select("sent_id", "pcs", tx.target_word(F.col("text"), pos).alias("word"))
    wp = tk.pieces(F.col("word"), style)
    if style == "marker":  # the word is looked up with the blank before it
        wp = F.when(F.size(wp) > 0, F.concat(F.array(F.concat(F.lit(WORD_MARKER), F.get(wp, 0))), F.slice(wp, 2, 2**31 - 1))).otherwise(wp)
    w = w.select("sent_id", "pcs", wp.alias("wp"))
    spans = w.select("sent_id", tk.locate_span(F.col("pcs"), F.col("wp"), last_occurrence).alias("start"),
                     F.size("wp").alias("k"))
    s = tk.span_score(token_scores, spans, average=True)
    return s.select("sent_id", F.round("score", 6).alias("score"))
