"""PPMI plausibility scores (P1, P2) and their reports (K3-K5).

P1 (syntax PPMI): an item is ``subject, verb, arg...`` (the verb is always
slot 1). Its components are ``(verb, subject, NSUBJ)`` and ``(verb, arg,
role)`` for each further argument; a component's weight is the Laplace
smoothed PPMI (or the plain PPMI) of its triple against the (word, role)
marginals, ``N`` = total triple frequency, ``V`` = number of triples; the
item score is the sum.

P2 (pair PPMI): the same on plain lemmas, pairs ``(subject, verb)`` and
``(verb, arg)`` against a windowed pair-count table; ``N`` = total lemma
frequency, ``V`` = number of lemmas.

Plan notes: the items are the streamed side; the triple, marginal and pair
tables are corpus-sized and joined by shuffle (AQE turns any of them into a
broadcast only after measuring it small, and splits skewed keys). The
one-row totals are attached by broadcast. The marginals and the kept
vocabulary are aggregates; they are written first, as Spark could not split a
frequent verb or word in a join with an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PPMI_LOG_FORMAT, SCORE_FLAG, ZERO_SCORE_FLAG
from ..functions import assoc
from ..operators.counting import triple_totals, word_role_marginals
from ..operators.ranking import with_scalars
from ..session import written


def components(items_wide: DataFrame) -> DataFrame:
    """``(item_id, part, v, arg, role)``: part 0 is the subject component,
    parts 1.. the arguments after the verb, all keyed ``lemma@POS``."""
    verb = F.col("slots")[1]
    exploded = items_wide.select(
        "item_id", F.concat(verb["lemma"], F.lit("@"), verb["pos"]).alias("v"),
        F.posexplode(F.filter("slots", lambda s: s["slot"] != 1)).alias("part", "s"))
    return exploded.select("item_id", "part", "v",
                           F.concat(F.col("s.lemma"), F.lit("@"), F.col("s.pos")).alias("arg"),
                           F.col("s.role").alias("role"))


def _stats(c: DataFrame) -> DataFrame:
    return c.select("item_id", "part", "v", "arg", "role",
                    F.coalesce("ab", F.lit(0.0)).alias("ab"),
                    F.coalesce("a", F.lit(0.0)).alias("a"),
                    F.coalesce("b", F.lit(0.0)).alias("b"),
                    F.col("n"), F.col("v_total").alias("vocab"))


def component_scores(stats: DataFrame, smooth: bool = True) -> DataFrame:
    ab, a, b, n, v = (F.col(c) for c in ("ab", "a", "b", "n", "vocab"))
    val = assoc.laplace(ab, a, b, n, v) if smooth else assoc.ppmi(ab, a, b, n)
    return stats.withColumn("value", val)


def ppmi_syntax(items_wide: DataFrame, triples: DataFrame, smooth: bool = True) -> DataFrame:
    """``(item_id, score, raw_freq, n_parts)``."""
    scored = component_scores(syntax_stats(items_wide, triples), smooth)
    return scored.groupBy("item_id").agg(
        F.round(F.sum("value"), 6).alias("score"),
        F.sum("ab").alias("raw_freq"),
        F.count(F.lit(1)).alias("n_parts"))


def syntax_stats(items_wide: DataFrame, triples: DataFrame) -> DataFrame:
    marg = written(word_role_marginals(triples), "marginals")
    tot = triple_totals(triples).withColumnRenamed("v", "v_total")
    t = triples.select(F.col("head").alias("v"), F.col("dep").alias("arg"), "role", F.col("freq").alias("ab"))
    ma = marg.select(F.col("w").alias("arg"), "role", F.col("f").alias("a"))
    mb = marg.select(F.col("w").alias("v"), "role", F.col("f").alias("b"))
    c = (components(items_wide).join(t, ["v", "arg", "role"], "left")
         .join(ma, ["arg", "role"], "left")
         .join(mb, ["v", "role"], "left"))
    return _stats(with_scalars(c, tot))


def _fmt(c):
    return F.format_string("%.6f", F.round(c, 6))


def report_ppmi(items_wide: DataFrame, triples: DataFrame, smooth: bool = True, print_all: bool = True) -> DataFrame:
    """K3: ``(item_id, text, parts, score)``; ``parts`` are the component
    values in order, comma separated (dropped with ``print_all=False``).
    The items' files are small and their rows are not: the merge hint keeps
    the texts from being broadcast."""
    scored = component_scores(syntax_stats(items_wide, triples), smooth)
    agg = scored.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "value"))).alias("pv"),
        F.round(F.sum("value"), 6).alias("score"))
    text = items_wide.select("item_id", F.concat_ws(" ", F.transform("slots", lambda s: s["lemma"])).alias("text"))
    out = agg.join(text.hint("merge"), "item_id").select(
        "item_id", "text", F.concat_ws(",", F.transform("pv", lambda x: _fmt(x["value"]))).alias("parts"), "score")
    return out if print_all else out.drop("parts")


def explain_ppmi(items_wide: DataFrame, triples: DataFrame, smooth: bool = True) -> DataFrame:
    """K4: per item the log line: one ``head-dep-role freq:x ppmi:y`` per
    component, and ``zero_score`` when all raw frequencies are 0."""
    scored = component_scores(syntax_stats(items_wide, triples), smooth)
    line = F.format_string(PPMI_LOG_FORMAT, F.col("v"), F.col("arg"), F.col("role"),
                           F.format_string("%.1f", F.col("ab")), _fmt(F.col("value")))
    agg = scored.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("part", line.alias("line")))).alias("pl"),
        F.sum("ab").alias("raw"))
    return agg.select("item_id", F.concat_ws("\t", F.transform("pl", lambda x: x["line"])).alias("log"),
                      F.when(F.col("raw") == 0, ZERO_SCORE_FLAG).otherwise(SCORE_FLAG).alias("flag"))


# ---------------------------------------------------------------- P2
def pair_items(sentence_tokens: DataFrame) -> DataFrame:
    """Lemma-only items ``(item_id, words array<string>)`` (F6): whole
    sentences with at least a subject and a verb."""
    return sentence_tokens.where(F.size("words") >= 2)


def item_vocab(items: DataFrame) -> DataFrame:
    """Distinct words over all items."""
    return items.select(F.explode("words").alias("word")).distinct()


def pairs_in_vocab(pairs: DataFrame, lemmas: DataFrame, vocab: DataFrame) -> DataFrame:
    """A pair is kept only if each word is in the lemma table and in
    the item vocabulary. One semi join per side against the (small)
    intersection of both word sets."""
    keep = written(lemmas.select("word").join(vocab, "word", "left_semi"), "kept_words")
    for side in ("w1", "w2"):
        pairs = pairs.join(keep.select(F.col("word").alias(side)), side, "left_semi")
    return pairs


def pair_stats(items: DataFrame, lemmas: DataFrame, pairs: DataFrame) -> DataFrame:
    """Components ``(item_id, part, w1, w2, ab, a, b, n, vocab)`` of P2.

    S8/S9: the pair table is first reduced to pairs whose words are both in
    the lemma table and in the item vocabulary (semi joins); N and V come
    from the lemma table."""
    comps = items.select(
        "item_id", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("words") - 1),
            lambda i: F.when(i == 1, F.struct(F.col("words")[0].alias("w1"), F.col("words")[1].alias("w2")))
            .otherwise(F.struct(F.col("words")[1].alias("w1"), F.col("words")[i].alias("w2"))))).alias("part", "c"))
    comps = comps.select("item_id", "part", "c.w1", "c.w2")
    lem = lemmas.select("word", "freq")
    p = pairs_in_vocab(pairs, lem, item_vocab(items))
    tot = lem.agg(F.sum("freq").alias("n"), F.count(F.lit(1)).cast("double").alias("vocab"))
    c = (comps.join(p.select("w1", "w2", F.col("freq").alias("ab")), ["w1", "w2"], "left")
         .join(lem.select(F.col("word").alias("w1"), F.col("freq").alias("a")), "w1", "left")
         .join(lem.select(F.col("word").alias("w2"), F.col("freq").alias("b")), "w2", "left"))
    c = with_scalars(c, tot)
    return c.select("item_id", "part", "w1", "w2",
                    F.coalesce("ab", F.lit(0.0)).alias("ab"), F.coalesce("a", F.lit(0.0)).alias("a"),
                    F.coalesce("b", F.lit(0.0)).alias("b"), "n", "vocab")


def pair_ppmi(items: DataFrame, lemmas: DataFrame, pairs: DataFrame, smooth: bool = True) -> DataFrame:
    """``(item_id, score, raw_freq, n_parts)``."""
    scored = component_scores(pair_stats(items, lemmas, pairs), smooth)
    return scored.groupBy("item_id").agg(
        F.round(F.sum("value"), 6).alias("score"),
        F.sum("ab").alias("raw_freq"),
        F.count(F.lit(1)).alias("n_parts"))
