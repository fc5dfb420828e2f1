"""Filler candidates in impact-ordered blocks, and the best of them by threshold.

The candidates of a context (the other side of each of its bigrams) are dealt
into blocks of one role, one half octave of joint frequency and one of the
filler's own frequency. A block's header holds its size and extreme
frequencies, which bound the weight of everything in it. For the best N of a
probe (context, target role) only headers are ranked: the blocks of highest
bound that hold N candidates are read and weighted, their N-th weight is the
threshold, and of the other blocks only those are read whose bound reaches
it. A frequent context with millions of rare partners is read at its top.

The number of headers of a context depends on the span of the frequencies and
not on the number of candidates, so no step holds a context's candidates in
one task; blocks are joined by their whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import assoc
from ..functions import text as tx
from ..operators.counting import verb_total
from ..operators.ranking import rank_within, with_scalars
from ..session import scratch_path

BLOCK = ["w", "role", "in_space", "freq_step", "filler_step"]
#: Weights are rounded to 9 places before they are compared; bounds are widened by more than that.
SLACK = 1e-8


def half_octave(x: Column) -> Column:
    return F.floor(2 * F.log2(x)).cast("int")


def candidate_index(bigrams: DataFrame, lemma_pos_freqs: DataFrame, in_space: DataFrame, filler_key) -> tuple[DataFrame, DataFrame]:
    """``(index, dropped)``: every candidate with its block, and those whose filler has no frequency.

    ``in_space(vkey)``: keys of the vectors; ``filler_key`` maps the filler
    column to such a key. Index rows are ``w, role, filler, freq, fo`` and the
    block's ``in_space, freq_step, filler_step``, written in that order so that
    row groups can be skipped.
    """
    from .thematic import both_directions

    cand = both_directions(bigrams).select("w", tx.role_of(F.col("o")).alias("role"), tx.strip_role(F.col("o")).alias("filler"), "freq")
    cand = cand.join(lemma_pos_freqs.select(F.col("lemma_pos").alias("filler"), F.col("freq").alias("fo")), "filler", "left")
    known = cand.where(F.col("fo").isNotNull()).withColumn("vkey", filler_key(F.col("filler")))
    known = known.join(in_space.select("vkey", F.lit(True).alias("in_space")), "vkey", "left")
    index = known.select("w", "role", "filler", "freq", "fo", F.coalesce("in_space", F.lit(False)).alias("in_space"),
                         half_octave(F.col("freq")).alias("freq_step"), half_octave(F.col("fo")).alias("filler_step"))
    by = ["w", "role", F.desc("freq_step"), "filler_step"]
    return index.repartitionByRange(*by).sortWithinPartitions(*by), cand.where(F.col("fo").isNull()).select("w", "role", "filler", "freq")


def block_headers(index: DataFrame) -> DataFrame:
    """One row per block: ``n`` candidates, least and greatest joint frequency, least filler frequency."""
    return index.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min("freq").alias("least"), F.max("freq").alias("most"),
                                     F.min("fo").alias("fo_least"))


def with_context_freq(probes: DataFrame, lemma_pos_freqs: DataFrame) -> DataFrame:
    """Probes ``(w, t_role)`` with the context's own frequency ``fw``; probes without one have no list."""
    return (probes.withColumn("wk", tx.strip_role(F.col("w")))
            .join(lemma_pos_freqs.select(F.col("lemma_pos").alias("wk"), F.col("freq").alias("fw")), "wk").drop("wk"))


def bounded_headers(headers: DataFrame, probes: DataFrame, lemma_pos_freqs: DataFrame, weight: str, wanted: dict[str, int]) -> DataFrame:
    """The blocks of each probe and family (``all`` candidates, or those in the vector ``space``) with their bound.

    A weight falls with the filler's frequency and is convex in the joint
    frequency, so its greatest value in a block is at the least filler
    frequency and one of the two extreme joint ones. ``seed`` marks the
    blocks of highest bound that together hold the wanted number.
    """
    fn = assoc.by_name(weight)
    heads = headers.join(probes, "w").where(F.col("role").startswith(F.col("t_role")))
    families = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(k).alias("wanted")) for f, k in wanted.items()])
    heads = heads.select("*", F.inline(families)).where((F.col("family") == "all") | F.col("in_space"))
    heads = with_scalars(heads, verb_total(lemma_pos_freqs))
    at = lambda f: F.coalesce(fn(F.col(f), F.col("fw"), F.col("fo_least"), F.col("n_verb")), F.lit(float("-inf")))
    heads = heads.withColumn("bound", F.greatest(at("least"), at("most")) + SLACK)
    before = Window.partitionBy("w", "t_role", "family").orderBy(F.desc("bound"), *BLOCK[1:]).rowsBetween(Window.unboundedPreceding, -1)
    return heads.withColumn("seed", F.coalesce(F.sum("n").over(before), F.lit(0)) < F.col("wanted")) \
        .select(*BLOCK, "n", "t_role", "family", "wanted", "fw", "n_verb", "bound", "seed")


def _weighted(index: DataFrame, blocks: DataFrame, weight: str) -> DataFrame:
    fn = assoc.by_name(weight)
    value = F.round(fn(F.col("freq"), F.col("fw"), F.col("fo"), F.col("n_verb")), 9)
    return index.join(blocks.select(*BLOCK, "t_role", "family", "wanted", "fw", "n_verb"), BLOCK) \
        .select("w", "t_role", "family", "wanted", "filler", "role", "in_space", value.alias("weight"))


def _best(rows: DataFrame) -> DataFrame:
    order = [F.col("weight").desc(), F.col("filler").asc(), F.col("role").asc()]
    return rank_within(rows, ["w", "t_role", "family"], order, "rk").where(F.col("rk") <= F.col("wanted"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"fillers/{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def best_fillers(index: DataFrame, headers: DataFrame, probes: DataFrame, lemma_pos_freqs: DataFrame, weight: str = "lmi",
                 n: int = 200, m: int = 20) -> tuple[DataFrame, DataFrame]:
    """``(best, blocks)``: the first ``n`` candidates of each probe, and the first ``m`` that have a vector.

    ``best(w, t_role, family, rk, filler, role, in_space, weight)`` equals
    ranking all candidates. ``blocks`` tells which were read (``read``) and how
    many candidates each holds (``n``).
    """
    heads = _written(bounded_headers(headers, with_context_freq(probes, lemma_pos_freqs), lemma_pos_freqs, weight, {"all": n, "space": m}), "headers")
    first = _written(_best(_weighted(index, heads.where("seed"), weight)), "seeds")
    floor = first.groupBy("w", "t_role", "family").agg(
        F.when(F.count(F.lit(1)) == F.first("wanted"), F.min("weight")).alias("floor"))
    rest = heads.where(~F.col("seed")).join(floor, ["w", "t_role", "family"], "left")
    reach = F.col("bound") >= F.coalesce("floor", F.lit(float("-inf")))
    more = _weighted(index, rest.where(reach), weight)
    best = _best(first.drop("rk").unionByName(more)).drop("wanted")
    blocks = heads.where("seed").select(*BLOCK, "t_role", "family", "n", F.lit(True).alias("read")).unionByName(
        rest.select(*BLOCK, "t_role", "family", "n", reach.alias("read")))
    return best, blocks


def ranked_arrays(best: DataFrame) -> DataFrame:
    """One row per probe: ``top``, its best candidates in order, and ``space``, the best that have a vector."""
    rows = best.groupBy("w", "t_role").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("family") == f, F.struct(*[F.col(c) for c in cols])))).alias(name)
        for f, name, cols in (("all", "top", ("rk", "filler", "weight", "in_space")), ("space", "space", ("rk", "filler", "weight")))])
    return rows
