"""Thematic fit for many parameter settings in one pass.

The settings (list length N, prototype size M, update function) differ only in
how much of a probe's ranked list they read. Each list is ranked once, at the
largest N and M, and kept as an array; a small table of settings says which
prefix each one takes. Lists are intersected once per N, both update functions
are computed by the same aggregate, and prototypes of equal fillers are shared
by all context keys and settings that choose them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from .thematic import FALLBACK, NO_FILLERS, ONE_LIST, UPDATE, TFParams, filler_vkey


def settings_array(params: Sequence[TFParams]) -> Column:
    """The table of settings as an array of literals, numbered in the caller's order."""
    return F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(p.list_length).alias("list_length"), F.lit(p.n_centroid).alias("n_centroid"),
                              F.lit(p.update).alias("update_fn"), F.lit(p.exact_mean).alias("exact_mean")) for i, p in enumerate(params)])


def key_table(keys: DataFrame, attested: DataFrame) -> DataFrame:
    """``(ctx_key, t_role, ws)``: every context key with its attested contexts in order (none: an empty array)."""
    ws = attested.groupBy("ctx_key").agg(F.sort_array(F.collect_list(F.struct("li", "w")))["w"].alias("ws"))
    return keys.select("ctx_key", "t_role").join(ws.hint("merge"), "ctx_key", "left").select(
        "ctx_key", "t_role", F.coalesce("ws", F.array().cast("array<string>")).alias("ws"))


def dictionaries(ranked: DataFrame, params: Sequence[TFParams]) -> DataFrame:
    """W2 + W3 for every N: ``(w, t_role, list_length, filler, weight, in_space)``; a repeated filler keeps its later weight."""
    lengths = F.array(*[F.lit(n) for n in sorted({p.list_length for p in params})])
    top = ranked.select("w", "t_role", F.inline("top")).withColumn("list_length", F.explode(F.filter(lengths, lambda n: n >= F.col("rk"))))
    return top.groupBy("w", "t_role", "list_length", "filler").agg(
        F.max_by("weight", "rk").alias("weight"), F.first("in_space").alias("in_space"))


def updated_lists(keys: DataFrame, ranked: DataFrame, params: Sequence[TFParams]) -> DataFrame:
    """W5 + A11 for every setting: ``(ctx_key, setting, n_in_space, chosen)`` of keys whose intersection reaches the vectors."""
    several = keys.where(F.size("ws") > 1).select("ctx_key", "t_role", F.size("ws").alias("nl"), F.explode("ws").alias("w"))
    # a key's rows number at most its contexts times the sum of all N; once they lie together no later step moves them
    met = several.join(dictionaries(ranked, params), ["w", "t_role"]).repartition("ctx_key")
    common = met.groupBy("ctx_key", "list_length", "filler").agg(
        F.count(F.lit(1)).alias("c"), F.first("nl").alias("nl"), F.first("in_space").alias("in_space"),
        F.product("weight").alias("as_product"), F.sum("weight").alias("as_sum")).where((F.col("c") == F.col("nl")) & F.col("in_space"))
    score = F.round(F.when(F.col("update_fn") == "prod", F.col("as_product")).otherwise(F.col("as_sum")), 9)
    same = F.filter(settings_array(params), lambda s: s["list_length"] == F.col("list_length"))
    each = common.withColumn("s", F.explode(same)).select(
        "ctx_key", "filler", "as_product", "as_sum", "s.setting", "s.n_centroid", "s.update_fn").withColumn("score", score)
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("rank"), "filler", F.col("score").alias("weight"))))
    best = F.slice(order, 1, F.first("n_centroid"))
    return each.groupBy("ctx_key", "setting").agg(F.count(F.lit(1)).alias("n_in_space"), best.alias("chosen")).withColumn(
        "chosen", F.transform("chosen", lambda x, i: F.struct((i + 1).alias("r"), x["filler"].alias("filler"), x["weight"].alias("weight"))))


def models(keys: DataFrame, ranked: DataFrame, params: Sequence[TFParams]) -> DataFrame:
    """P5 + W4: ``(setting, n_centroid, exact_mean, ctx_key, operation, nl, n_in_space, chosen)``, the prototype's fillers in order.

    ``ranked`` must reach the largest N and M of ``params``; the fallback is the second attested list.
    """
    if any(p.fallback != "second" for p in params):
        raise ValueError("only the fallback to the second list is computed in one pass")
    each = keys.select("ctx_key", "t_role", "ws", F.explode(settings_array(params)).alias("s")).select(
        "ctx_key", "t_role", "ws", "s.setting", "s.n_centroid", "s.exact_mean")
    j = each.join(updated_lists(keys, ranked, params), ["ctx_key", "setting"], "left")
    nl = F.size("ws")
    operation = (F.when(nl == 0, F.lit(NO_FILLERS)).when(nl == 1, F.lit(ONE_LIST))
                 .when(F.col("n_in_space") > 0, F.lit(UPDATE)).otherwise(F.lit(FALLBACK)))
    j = j.withColumn("operation", operation).withColumn(
        "w", F.when(F.col("operation") == ONE_LIST, F.get("ws", F.lit(0))).when(F.col("operation") == FALLBACK, F.get("ws", F.lit(1))))
    lists = ranked.select("w", "t_role", F.transform("space", lambda x: F.struct(x["rk"].alias("r"), x["filler"].alias("filler"), x["weight"].alias("weight")))
                          .alias("own"))
    j = j.join(lists, ["w", "t_role"], "left")
    none = F.array().cast("array<struct<r:int,filler:string,weight:double>>")
    return j.select("setting", "n_centroid", "exact_mean", "ctx_key", "operation", F.when(nl > 0, nl.cast("long")).alias("nl"), "n_in_space",
                    F.coalesce("chosen", F.slice("own", 1, F.col("n_centroid")), none).alias("chosen"))


def scores(item_keys: DataFrame, model: DataFrame, vectors: DataFrame, with_pos: bool = False) -> DataFrame:
    """``(item_id, setting, score)``.

    A prototype is named by its size and fillers, so equal ones are summed
    once; cosines are taken once per prototype and target word. The items meet
    the scores of their (context key, target word) in one join at the end:
    long names of prototypes do not travel with them. Their files are small
    and their rows are not, so merge hints keep them, and their distinct
    pairs, from going through the driver.
    """
    name = F.concat_ws("\t", F.col("n_centroid").cast("string"), F.col("exact_mean").cast("string"),
                       F.transform("chosen", lambda x: filler_vkey(x["filler"], with_pos)))
    named = model.select("setting", "ctx_key", name.alias("proto"))
    parts = F.split("proto", "\t")
    protos = named.select("proto").distinct().select(
        "proto", F.get(parts, 0).cast("double").alias("m"), F.get(parts, 1).cast("boolean").alias("exact"), F.posexplode(F.slice(parts, 3, F.size(parts))).alias("r", "vkey"))
    cv = protos.join(vectors.select(F.col("word").alias("vkey"), "vec"), "vkey")
    g = cv.groupBy("proto", "m", "exact").agg(F.sort_array(F.collect_list(F.struct("r", "vec"))).alias("rv"), F.count(F.lit(1)).alias("n"))
    total = vx.vec_sum(F.transform("rv", lambda x: x["vec"]))
    div = F.when(F.col("exact"), F.col("n").cast("double")).otherwise(F.col("m"))
    cents = g.select("proto", F.when(F.col("n") == 1, F.element_at("rv", 1)["vec"]).otherwise(vx.scale(total, div)).alias("centroid"))
    items = item_keys.select("item_id", "ctx_key", vx.vec_key(F.col("t_lemma"), F.col("t_pos"), with_pos).alias("tkey"))
    asked = items.select("ctx_key", "tkey").distinct().join(named.hint("merge"), "ctx_key")
    pairs = asked.select("proto", "tkey").distinct().join(cents, "proto", "left").join(
        vectors.select(F.col("word").alias("tkey"), F.col("vec").alias("tvec")), "tkey", "left")
    score = F.when(F.col("centroid").isNull(), F.lit(0.0)).otherwise(F.round(vx.cosine(F.col("tvec"), F.col("centroid")), 6))
    scored = asked.join(pairs.select("proto", "tkey", score.alias("score")), ["proto", "tkey"], "left").select(
        F.col("ctx_key").alias("_key"), F.col("tkey").alias("_tkey"), "setting", "score")
    # an item without a target word keeps its row
    return items.join(scored.hint("merge"), (F.col("ctx_key") == F.col("_key")) & F.col("tkey").eqNullSafe(F.col("_tkey"))).select(
        "item_id", "setting", "score")
