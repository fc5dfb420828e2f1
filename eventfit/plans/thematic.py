"""Thematic fit with expectation update.

For an item ``contexts..., target`` (all ``lemma@pos@role``; the target is
the last slot, its role cut at ``:``):

1. every context seen in the bigram table gets a list of fillers: the other
   side of each bigram it takes part in (either side), kept when that
   side's role starts with the target role, weighted by LMI (or PPMI) with
   the verb total as N, sorted by weight (P3);
2. two or more lists: the top N of each are intersected and the weights of
   a common filler combined by product or sum (P4);
3. the first M fillers that have a vector form the prototype, their
   centroid (sum / M, or the vector itself when there is one) (P6); with one
   list that list is used, with an empty intersection (or none of it in the
   vector space) the list of the *second* attested context (P5);
4. the score is the cosine of the target's vector and the centroid: NULL
   for a target without vector, 0.0 without a centroid (P7, P8).

Spark plan. Results depend only on (contexts, target role), exactly as the
reference keys its result dictionary, so items are reduced to distinct
context keys first. Filler lists are computed once per distinct probe
(context, target role) with one hash join of the probes against a
both-directions view of the bigram table (no scan per item, no OR join).
Ranking uses ``row_number() <= k`` (partial WindowGroupLimit before the
shuffle), so a context with millions of candidates ships at most k rows per
map task. Vectors are joined only for the at most M chosen fillers per key
and for the targets; centroids aggregate at most M vectors per key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import assoc
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators.counting import attested_args, verb_total
from ..constants import (FILLER_FORMAT, OP_FALLBACK, OP_NO_FILLERS, OP_ONE_LIST, OP_UPDATE, TF_CENTROID_SIZE,
                         TF_LIST_LENGTH, TF_UPDATE, TF_WEIGHT)
from ..operators.ranking import rank_within, rank_within_spread, with_scalars
from ..session import written

UPDATE, ONE_LIST, NO_FILLERS, FALLBACK = OP_UPDATE, OP_ONE_LIST, OP_NO_FILLERS, OP_FALLBACK


@dataclass(frozen=True)
class TFParams:
    list_length: int = TF_LIST_LENGTH   # N: fillers per list before the intersection
    n_centroid: int = TF_CENTROID_SIZE  # M: fillers in the prototype
    weight: str = TF_WEIGHT             # association measure
    update: str = TF_UPDATE             # prod | add
    with_pos: bool = False      # vector keys 'form' or 'form/pos'
    exact_mean: bool = False    # divide by the number of vectors instead of M
    fallback: str = "second"    # 'second': the second attested list, even when empty (reference);
                                # 'nonempty': the second list, else the first list with fillers in space


@dataclass
class TFInputs:
    items_wide: DataFrame
    bigrams: DataFrame
    lemma_pos_freqs: DataFrame
    vectors: DataFrame


# ------------------------------------------------------------------ keys
def item_keys(items_wide: DataFrame) -> DataFrame:
    """``(item_id, ctx_key, ctx, t_role, t_lemma, t_pos)`` - no shuffle."""
    ctx = F.slice("slots", 1, F.size("slots") - 1)
    tgt = F.element_at("slots", -1)
    t_role = F.substring_index(tgt["role"], ":", 1)
    key = F.concat(F.concat_ws("\t", F.transform(ctx, lambda s: tx.item_string(s["lemma"], s["pos"], s["role"]))),
                   F.lit("|"), t_role)
    return items_wide.select("item_id", key.alias("ctx_key"), ctx.alias("ctx"), t_role.alias("t_role"),
                             tgt["lemma"].alias("t_lemma"), tgt["pos"].alias("t_pos"))


def distinct_keys(ik: DataFrame) -> DataFrame:
    # ctx and t_role are functions of ctx_key: a plain hash distinct
    return ik.select("ctx_key", "ctx", "t_role").distinct()


def key_contexts(keys: DataFrame) -> DataFrame:
    """``(ctx_key, t_role, ci, w)`` every context of every key."""
    return (keys.select("ctx_key", "t_role", F.posexplode("ctx").alias("ci", "s"))
            .select("ctx_key", "t_role", "ci",
                    tx.item_string(F.col("s.lemma"), F.col("s.pos"), F.col("s.role")).alias("w")))


def _attested(bigrams: DataFrame) -> DataFrame:
    """Written, so that a frequent context can be split in the joins with it."""
    return written(attested_args(bigrams), "attested_args")


def attested_contexts(keys: DataFrame, bigrams: DataFrame) -> DataFrame:
    """J7 + W6: ``(ctx_key, t_role, li, w)`` - contexts seen in the bigram
    table, ``li`` counted over attested contexts only."""
    att = key_contexts(keys).join(_attested(bigrams), "w", "left_semi")
    return rank_within(att, ["ctx_key"], [F.col("ci")], "li").withColumn("li", F.col("li") - 1).drop("ci")


def unattested_contexts(keys: DataFrame, bigrams: DataFrame) -> DataFrame:
    """J8."""
    return key_contexts(keys).join(_attested(bigrams), "w", "left_anti")


# ----------------------------------------------------------------- lists
def both_directions(bigrams: DataFrame) -> DataFrame:
    """``(w, o, freq)``: each bigram from both ends; a bigram whose two
    sides are equal appears once."""
    fwd = bigrams.select(F.col("a1").alias("w"), F.col("a2").alias("o"), "freq")
    bwd = bigrams.where(F.col("a1") != F.col("a2")).select(F.col("a2").alias("w"), F.col("a1").alias("o"), "freq")
    return fwd.unionByName(bwd)


def filler_lists(probes: DataFrame, inp: TFInputs, p: TFParams, dropped: tuple[Observation, Observation] | None = None) -> DataFrame:
    """P3 (J5, J6, M6/M9): ``(w, t_role, filler, role, weight)`` for every
    probe ``(w, t_role)``; weights rounded to 9 places so that ties are
    stable across engines.

    J6 leaves out contexts and candidates without a frequency. With two
    observations in ``dropped`` their numbers (``dropped`` of ``seen``, probes and
    candidates) are gathered by the same job that computes the lists."""
    lp = inp.lemma_pos_freqs

    def watched(df: DataFrame, col: str, i: int) -> DataFrame:
        if dropped is not None:
            df = df.observe(dropped[i], F.count(F.lit(1)).alias("seen"), F.count(F.when(F.col(col).isNull(), 1)).alias("dropped"))
        return df.where(F.col(col).isNotNull())

    # the context's own frequency belongs to the few probes, not to every candidate
    probes = watched(probes.withColumn("wk", tx.strip_role(F.col("w")))
                     .join(lp.select(F.col("lemma_pos").alias("wk"), F.col("freq").alias("fw")), "wk", "left").drop("wk"), "fw", 0)
    cand = (both_directions(inp.bigrams).join(probes, "w")
            .where(tx.role_of(F.col("o")).startswith(F.col("t_role"))))
    cand = watched(cand.withColumn("filler", tx.strip_role(F.col("o")))
                   .withColumn("role", tx.role_of(F.col("o")))
                   .join(lp.select(F.col("lemma_pos").alias("filler"), F.col("freq").alias("fo")), "filler", "left"), "fo", 1)
    cand = with_scalars(cand, verb_total(lp))
    wfn = assoc.by_name(p.weight)
    weight = F.round(wfn(F.col("freq"), F.col("fw"), F.col("fo"), F.col("n_verb")), 9)
    return cand.select("w", "t_role", "filler", "role", weight.alias("weight"))


def order_cols():
    return [F.col("weight").desc(), F.col("filler").asc(), F.col("role").asc()]


def ranked(lists: DataFrame) -> DataFrame:
    """``rk`` = position in the sorted list (1-based), for whole lists.
    A frequent context can own a large share of all candidates, so the full
    ranking is spread over range partitions instead of one window task
    (the top-N uses of the ranking below stay bounded windows)."""
    return rank_within_spread(lists, ["w", "t_role"], order_cols(), "rk")


def ranked_top(lists: DataFrame, n: int) -> DataFrame:
    """The first ``n`` ranks only: ``row_number() <= n`` gets a partial
    WindowGroupLimit before the shuffle."""
    return rank_within(lists, ["w", "t_role"], order_cols(), "rk").where(F.col("rk") <= n)


def top_n_dict(lists: DataFrame, n: int) -> DataFrame:
    """W2 + W3: the first N of each list as a filler -> weight dictionary;
    a filler twice in the top N keeps its later (lower) weight."""
    top = ranked_top(lists, n)
    return top.groupBy("w", "t_role", "filler").agg(F.max_by("weight", "rk").alias("weight"))


def vector_words(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("word").alias("vkey"))


def filler_vkey(filler: F.Column, with_pos: bool) -> F.Column:
    parts = F.split(filler, "@")
    return vx.vec_key(F.get(parts, 0), F.get(parts, 1), with_pos)


def first_m_in_space(lists: DataFrame, vectors: DataFrame, m: int, with_pos: bool) -> DataFrame:
    """W4 on whole lists: ``(w, t_role, r, filler, weight)``, the first M
    fillers that have a vector (duplicates kept)."""
    inv = (lists.withColumn("vkey", filler_vkey(F.col("filler"), with_pos))
           .join(vector_words(vectors), "vkey", "left_semi"))
    return (rank_within(inv, ["w", "t_role"], order_cols(), "r").where(F.col("r") <= m)
            .select("w", "t_role", "r", "filler", "weight"))


def intersection(att: DataFrame, topn: DataFrame, update: str) -> DataFrame:
    """W5 + A11: ``(ctx_key, filler, score)`` for keys with two or more
    attested contexts: fillers present in every top-N list, weights
    multiplied (``prod``) or added (``add``)."""
    nl = att.groupBy("ctx_key").agg(F.count(F.lit(1)).alias("nl"))
    j = att.join(nl.where(F.col("nl") >= 2), "ctx_key").join(topn, ["w", "t_role"])
    comb = F.product("weight") if update == "prod" else F.sum("weight")
    g = j.groupBy("ctx_key", "filler", "nl").agg(F.count(F.lit(1)).alias("c"), comb.alias("score"))
    return g.where(F.col("c") == F.col("nl")).select("ctx_key", "filler", F.round("score", 9).alias("score"))


# ------------------------------------------------------------ prototypes
@dataclass
class Prototypes:
    keys: DataFrame          # (ctx_key, ctx, t_role)
    item_keys: DataFrame     # (item_id, ctx_key, ...)
    attested: DataFrame      # (ctx_key, t_role, li, w)
    lists: DataFrame         # (w, t_role, filler, role, weight)
    ops: DataFrame           # (ctx_key, operation, nl, n_in_space)
    chosen: DataFrame        # (ctx_key, r, filler, weight)
    updated: DataFrame       # (ctx_key, filler, score)


def prototypes(inp: TFInputs, p: TFParams, lists: DataFrame | None = None) -> Prototypes:
    ik = item_keys(inp.items_wide)
    keys = distinct_keys(ik)
    att = attested_contexts(keys, inp.bigrams)
    if lists is None:
        lists = filler_lists(att.select("w", "t_role").distinct(), inp, p)
    topn = top_n_dict(lists, p.list_length)
    upd = intersection(att, topn, p.update)
    vw = vector_words(inp.vectors)
    upd_in = upd.withColumn("vkey", filler_vkey(F.col("filler"), p.with_pos)).join(vw, "vkey", "left_semi")
    up_cnt = upd_in.groupBy("ctx_key").agg(F.count(F.lit(1)).alias("n_in_space"))
    upd_top = (rank_within(upd_in, ["ctx_key"], [F.col("score").desc(), F.col("filler").asc()], "r")
               .where(F.col("r") <= p.n_centroid)
               .select("ctx_key", "r", "filler", F.col("score").alias("weight")))
    nl = att.groupBy("ctx_key").agg(F.count(F.lit(1)).alias("nl"))
    ops = (keys.select("ctx_key").join(nl, "ctx_key", "left").join(up_cnt, "ctx_key", "left")
           .withColumn("operation",
                       F.when(F.col("nl").isNull(), F.lit(NO_FILLERS))
                       .when(F.col("nl") == 1, F.lit(ONE_LIST))
                       .when(F.col("n_in_space") > 0, F.lit(UPDATE))
                       .otherwise(F.lit(FALLBACK)))
           .withColumn("src_li", F.when(F.col("operation") == ONE_LIST, 0)
                       .when(F.col("operation") == FALLBACK, 1)))
    inv = first_m_in_space(lists, inp.vectors, p.n_centroid, p.with_pos)
    src = ops.where(F.col("src_li").isNotNull()).select("ctx_key", F.col("src_li").alias("li"))
    if p.fallback == "nonempty":
        # README variant: with an empty second list take another attested
        # list that has fillers in the space (the second, else the lowest li)
        has = att.join(inv.select("w", "t_role").distinct(), ["w", "t_role"], "left_semi")
        pref = F.when(F.col("li") == 1, F.lit(-1)).otherwise(F.col("li"))
        alt = (ops.where(F.col("operation") == FALLBACK).select("ctx_key").join(has, "ctx_key")
               .groupBy("ctx_key").agg(F.min_by("li", pref).alias("li")))
        src = src.join(alt.withColumnRenamed("li", "alt_li"), "ctx_key", "left").select(
            "ctx_key", F.coalesce("alt_li", "li").alias("li"))
    elif p.fallback != "second":
        raise ValueError(p.fallback)
    from_list = (src.join(att, ["ctx_key", "li"]).join(inv, ["w", "t_role"])
                 .select("ctx_key", "r", "filler", "weight"))
    from_upd = ops.where(F.col("operation") == UPDATE).select("ctx_key").join(upd_top, "ctx_key")
    chosen = from_list.unionByName(from_upd)
    return Prototypes(keys, ik, att, lists, ops.drop("src_li"), chosen, upd)


def centroids(pr: Prototypes, vectors: DataFrame, p: TFParams) -> DataFrame:
    """``(ctx_key, n_vecs, centroid)`` from the chosen fillers (at most
    M per key, so the collected group is bounded)."""
    v = vectors.select(F.col("word").alias("vkey"), "vec")
    cv = pr.chosen.withColumn("vkey", filler_vkey(F.col("filler"), p.with_pos)).join(v, "vkey")
    g = cv.groupBy("ctx_key").agg(F.sort_array(F.collect_list(F.struct("r", "vec"))).alias("rv"),
                                  F.count(F.lit(1)).alias("n_vecs"))
    total = vx.vec_sum(F.transform("rv", lambda x: x["vec"]))
    div = F.col("n_vecs").cast("double") if p.exact_mean else F.lit(float(p.n_centroid))
    cent = F.when(F.col("n_vecs") == 1, F.element_at("rv", 1)["vec"]).otherwise(vx.scale(total, div))
    return g.select("ctx_key", "n_vecs", cent.alias("centroid"))


def tf_scores(inp: TFInputs, p: TFParams, pr: Prototypes | None = None) -> DataFrame:
    """``(item_id, score)`` - cosine of target vector and centroid;
    NULL for a target without vector; 0.0 without centroid."""
    pr = pr or prototypes(inp, p)
    cents = centroids(pr, inp.vectors, p)
    tv = inp.vectors.select(F.col("word").alias("tkey"), F.col("vec").alias("tvec"))
    it = pr.item_keys.select("item_id", "ctx_key",
                             vx.vec_key(F.col("t_lemma"), F.col("t_pos"), p.with_pos).alias("tkey"))
    # the score depends on (context key, target word) only: vectors are
    # joined and cosines computed once per distinct pair, then the small
    # score table is joined back to the items
    pairs = it.select("ctx_key", "tkey").distinct()
    j = pairs.join(cents, "ctx_key", "left").join(tv, "tkey", "left")
    score = F.when(F.col("centroid").isNull(), F.lit(0.0)).otherwise(F.round(vx.cosine(F.col("tvec"), F.col("centroid")), 6))
    scored = j.select("ctx_key", "tkey", score.alias("score"))
    return it.join(scored, ["ctx_key", "tkey"], "left").select("item_id", "score")


def explain_prototype(pr: Prototypes) -> DataFrame:
    """K7: per item ``fillers`` = ``filler (weight rounded to 2)`` in
    prototype order, comma separated, and the operation.

    Items and model lie in small files of many rows: by merge hints neither
    goes through the driver. Written first, the keys' side is a plain scan, so
    that the items of a frequent key can be split."""
    lst = pr.chosen.groupBy("ctx_key").agg(F.sort_array(F.collect_list(F.struct("r", "filler", "weight"))).alias("fl"))
    fmt = F.transform("fl", lambda x: F.format_string(FILLER_FORMAT, x["filler"], (F.round(x["weight"], 2) + F.lit(0.0)).cast("string")))
    per_key = written(pr.ops.join(lst.hint("merge"), "ctx_key", "left").select(
        "ctx_key", "operation", F.coalesce(F.concat_ws(",", fmt), F.lit("")).alias("fillers")), "explained_keys")
    return pr.item_keys.select("item_id", "ctx_key").join(per_key.hint("merge"), "ctx_key").select("item_id", "fillers", "operation")


def with_model(inp: TFInputs, p: TFParams, lists: DataFrame, ops: DataFrame, chosen: DataFrame) -> Prototypes:
    """Prototypes whose operations and chosen fillers come from a written
    model (``catalog.tf_model``); the cheap per-item parts are derived."""
    ik = item_keys(inp.items_wide)
    keys = distinct_keys(ik)
    return Prototypes(keys, ik, None, lists, ops, chosen, None)


def sdm_scores(inp: TFInputs, p: TFParams, lists: DataFrame | None = None,
               pr: Prototypes | None = None) -> DataFrame:
    """P10: cos(target, LC) + cos(target, AC) with NULL parts skipped (NULL
    only when both are). AC is the context-updated prototype of P8; LC the
    prototype of the verb alone (its first M fillers in the vector space)."""
    pr = pr or prototypes(inp, p, lists)
    ac = centroids(pr, inp.vectors, p).select("ctx_key", F.col("centroid").alias("ac"))
    ik = pr.item_keys
    verb_probe = ik.select("item_id", "ctx_key", "t_role", "t_lemma", "t_pos",
                           tx.item_string(F.col("ctx")[1]["lemma"], F.col("ctx")[1]["pos"], F.col("ctx")[1]["role"]).alias("w"))
    # the verb is a context of every item, so its list is among the probe
    # lists whenever it is attested (an unattested verb has an empty list)
    vp = verb_probe.select("w", "t_role").distinct()
    vl = pr.lists.join(vp, ["w", "t_role"], "left_semi")
    inv = first_m_in_space(vl, inp.vectors, p.n_centroid, p.with_pos)
    v = inp.vectors.select(F.col("word").alias("vkey"), "vec")
    lc = (inv.withColumn("vkey", filler_vkey(F.col("filler"), p.with_pos)).join(v, "vkey")
          .groupBy("w", "t_role").agg(F.sort_array(F.collect_list(F.struct("r", "vec"))).alias("rv"),
                                      F.count(F.lit(1)).alias("n")))
    lc = lc.select("w", "t_role", F.when(F.col("n") == 1, F.element_at("rv", 1)["vec"])
                   .otherwise(vx.scale(vx.vec_sum(F.transform("rv", lambda x: x["vec"])), F.lit(float(p.n_centroid))))
                   .alias("lc"))
    tv = inp.vectors.select(F.col("word").alias("tkey"), F.col("vec").alias("tvec"))
    vp_items = verb_probe.withColumn("tkey", vx.vec_key(F.col("t_lemma"), F.col("t_pos"), p.with_pos))
    keys = ["ctx_key", "w", "t_role", "tkey"]
    # cosines once per distinct (context key, verb probe, target), then joined back
    j = (vp_items.select(*keys).distinct()
         .join(lc, ["w", "t_role"], "left").join(ac, "ctx_key", "left").join(tv, "tkey", "left"))
    c_lc = F.round(vx.cosine(F.col("tvec"), F.col("lc")), 6)
    c_ac = F.round(vx.cosine(F.col("tvec"), F.col("ac")), 6)
    scored = j.select(*keys, c_lc.alias("cos_lc"), c_ac.alias("cos_ac"))
    total = F.when(F.col("cos_lc").isNull() & F.col("cos_ac").isNull(), F.lit(None).cast("double")).otherwise(
        F.round(F.coalesce("cos_lc", F.lit(0.0)) + F.coalesce("cos_ac", F.lit(0.0)), 6))
    return vp_items.select("item_id", *keys).join(scored, keys, "left").select(
        "item_id", "cos_lc", "cos_ac", total.alias("score"))
