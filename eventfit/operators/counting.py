"""Counting, marginals and totals.

These are the corpus-sized steps. Every aggregate is a hash aggregate with a
map-side partial step, so a hot key is combined inside each map task before
the shuffle; no step collects a group into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_base
from ..sources.tables import table
from .pairs import window_pair_counts as window_pair_counts


def triple_counts(spark: SparkSession, sf_dir: str, min_freq: int = 0) -> DataFrame:
    """``<head, dependent, raw relation>`` counts over the fact table.

    Head = ``brand@V``; dependent = ``nation@N`` of the supplier for subject
    relations, else ``filler@N``. Plan: lineitem joins part once; the result
    is pre-aggregated to (verb, raw_rel, supplier | filler) before anything
    else is shuffled, and only the subject part - already reduced to one row
    per (verb, relation, supplier) - meets supplier/nation.
    """
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    is_subj = F.col("l_returnflag") == "R"
    pre = (li.join(part, li.l_partkey == part.p_partkey)
           .groupBy(F.col("p_brand").alias("verb"),
                    F.concat("l_returnflag", "l_linestatus").alias("raw_rel"),
                    F.when(is_subj, F.col("l_suppkey")).alias("suppkey"),
                    F.when(~is_subj, F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("filler"))
           .agg(F.count(F.lit(1)).alias("cnt")))
    sn = (table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
          .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
                F.col("s_nationkey") == F.col("n_nationkey"))
          .select(F.col("s_suppkey").alias("suppkey"), F.col("n_name").alias("dep_word")))
    subj_part = pre.where(F.col("suppkey").isNotNull()).join(sn, "suppkey")
    fill_part = pre.where(F.col("suppkey").isNull()).withColumn("dep_word", F.col("filler"))
    both = subj_part.select("verb", "dep_word", "raw_rel", "cnt").unionByName(
        fill_part.select("verb", "dep_word", "raw_rel", "cnt"))
    out = both.groupBy(F.concat(F.col("verb"), F.lit("@V")).alias("head"),
                       F.concat(F.col("dep_word"), F.lit("@N")).alias("dep"),
                       "raw_rel").agg(F.sum("cnt").cast("double").alias("freq"))
    return out.where(F.col("freq") >= min_freq) if min_freq else out


def map_triples(triples_raw: DataFrame, role_map: DataFrame, min_freq: float = 2.0,
                on_collision: str = "last") -> DataFrame:
    """S4 semantics on a raw triple table: minimum frequency, raw label ->
    role (unmapped labels dropped), and two raw labels of one role on the
    same key: the later line (greater ``raw_rel``) wins, or their counts are
    added with ``on_collision='sum'``.

    The role map is bounded by the number of relation labels, so it is
    broadcast."""
    t = triples_raw.where(F.col("freq") >= min_freq).join(F.broadcast(role_map), "raw_rel")
    if on_collision == "sum":
        return t.groupBy("head", "dep", "role").agg(F.sum("freq").alias("freq"))
    return t.groupBy("head", "dep", "role").agg(F.max_by("freq", "raw_rel").alias("freq"))


def word_role_marginals(triples: DataFrame) -> DataFrame:
    """A5: ``(w, role, f)`` - every triple adds its frequency to its head
    and to its dependent (twice when they are the same word)."""
    u = triples.select(F.col("head").alias("w"), "role", "freq").unionByName(
        triples.select(F.col("dep").alias("w"), "role", "freq"))
    return u.groupBy("w", "role").agg(F.sum("freq").alias("f"))


def triple_totals(triples: DataFrame) -> DataFrame:
    """One row ``(n, v)`` - total frequency and number of triples."""
    return triples.agg(F.sum("freq").alias("n"), F.count(F.lit(1)).cast("double").alias("v"))


def verb_total(lemma_pos_freqs: DataFrame) -> DataFrame:
    """One row ``(n_verb)`` - total frequency of verb lemmas."""
    return lemma_pos_freqs.agg(
        F.coalesce(F.sum(F.when(F.col("lemma_pos").endswith("@V"), F.col("freq"))), F.lit(0.0)).alias("n_verb"))


def attested_args(bigrams: DataFrame) -> DataFrame:
    """Every argument string seen on either side of a bigram."""
    return bigrams.select(F.col("a1").alias("w")).union(bigrams.select(F.col("a2").alias("w"))).distinct()


def lemma_counts(toks: DataFrame, min_freq: int = 1) -> DataFrame:
    """``(word, freq)`` token counts with a minimum frequency."""
    return (toks.groupBy(F.col("tok").alias("word")).agg(F.count(F.lit(1)).cast("double").alias("freq"))
            .where(F.col("freq") >= min_freq))


def sentence_index(df: DataFrame, order_cols: list[str], index_col: str = "idx") -> DataFrame:
    """0-based running number over the whole table in ``order_cols``
    order, computed as in ``ranking.dense_index`` (range partitions plus
    offsets), so no single task sees all rows."""
    d = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
         .withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    checkpoint_base(df.sparkSession)  # the shared folder, read from the session
    d = d.checkpoint()  # both branches below read the same partitioned copy
    per_part = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    offsets = per_part.select("_p", "_m0", F.sum("_n").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_off"))
    return (d.join(F.broadcast(offsets), "_p")
            .withColumn(index_col, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_m") - F.col("_m0")).cast("long"))
            .drop("_p", "_m", "_m0", "_off"))
