"""Corpus-shaped inputs derived from the driver tables (FIXTURES.md, part B).

The reference reads frequency tables, role-annotated items, sentences and
vectors that it does not ship. Here each of them is a DataFrame that Spark
derives from the driver's tables, so every downstream plan reads real,
scale-growing data:

* ``base``           one row per lineitem: verb = part brand, subject = the
                     supplier's nation, filler = part name, raw relation =
                     return flag + line status;
* ``role_map``       raw relation label -> role (read off lineitem);
* ``triples_raw``    <head, dependent, raw relation> counts;
* ``items``          one role-annotated item per order (3 or 4 slots);
* ``bigrams``        role-typed argument pairs with counts;
* ``lemma_pos_freqs`` lemma@pos marginal counts;
* ``vectors``        word vectors taken from ``embeddings``;
* ``toks``, ``sents`` corpus tokens and sentences from the text tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counting import sentence_index
from ..operators.ranking import dense_index, with_scalars
from .tables import spread, table

# Fixed values of the derivation (shared with the SQL oracle).
UNATTESTED_SUBJ = "NATION_99"
UNATTESTED_VERB = "Brand#99"
EXTRA_SLOT_ROLE = "OBL:on"
HEAD_LABEL, HEAD_ROLE = "HEAD", "ROOT"
SUBJECT_FLAG = "R"


def role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(raw_rel, role)``: every raw label that occurs in lineitem, plus the
    verb-head label. Distinct over two columns: a partial aggregate, tiny
    shuffle."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    mapped = li.select(
        F.concat(flag, status).alias("raw_rel"),
        F.when(flag == SUBJECT_FLAG, "NSUBJ").when(flag == "N", "OBJ")
        .when(status == "F", "OBL:on").otherwise("OBL:for").alias("role"))
    head = spark.range(1).select(F.lit(HEAD_LABEL).alias("raw_rel"), F.lit(HEAD_ROLE).alias("role"))
    return mapped.unionByName(head)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows ``(verb, subj, filler, raw_rel)``; only the seven needed
    columns are scanned."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .join(supp, li.l_suppkey == supp.s_suppkey)
            .join(nation, supp.s_nationkey == nation.n_nationkey)
            .select(F.col("p_brand").alias("verb"), F.col("n_name").alias("subj"),
                    F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("filler"),
                    F.concat("l_returnflag", "l_linestatus").alias("raw_rel")))


def fillers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct filler names with their 0-based rank ``k`` in name order."""
    part = table(spark, sf_dir, "part").select(
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("filler"))
    return dense_index(part, "filler", "k")


def items_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_wide_from(spark, sf_dir, fillers(spark, sf_dir))


def items_wide_from(spark: SparkSession, sf_dir: str, fl: DataFrame) -> DataFrame:
    """Role-annotated items ``(item_id, slots array<struct<slot, lemma, pos, role>>)``.

    One item per order. Slot 0 is the subject, slot 1 the verb, slot 2 the
    object; orders with ``o_orderkey % 4 = 1`` get a fourth, oblique slot.
    Every 17th subject and every 13th verb is one that the corpus never
    attests, so all fallbacks of the thematic-fit model are reached.
    """
    nf = fl.agg(F.count(F.lit(1)).alias("nf"))
    ok = F.col("o_orderkey")
    orders = with_scalars(spread(table(spark, sf_dir, "orders").select("o_orderkey")), nf)
    orders = orders.select(
        ok.alias("item_id"),
        F.when(ok % 17 == 0, F.lit(UNATTESTED_SUBJ))
        .otherwise(F.concat(F.lit("NATION_"), (ok % 25).cast("string"))).alias("subj"),
        F.when(ok % 13 == 0, F.lit(UNATTESTED_VERB))
        .otherwise(F.concat(F.lit("Brand#"), (1 + (ok * 7) % 25).cast("string"))).alias("verb"),
        ((ok * 11 + 3) % F.col("nf")).alias("k_obj"),
        F.when(ok % 4 == 1, (ok * 5 + 1) % F.col("nf")).alias("k_obl"))
    # fillers has one row per distinct name (a dimension): AQE broadcasts it
    # when it measures it small and shuffles otherwise
    obj = fl.select(F.col("k").alias("k_obj"), F.col("filler").alias("obj"))
    obl = fl.select(F.col("k").alias("k_obl"), F.col("filler").alias("obl"))
    wide = orders.join(obj, "k_obj").join(obl, "k_obl", "left")

    def slot(i, lemma, pos, role):
        return F.struct(F.lit(i).alias("slot"), lemma.alias("lemma"), F.lit(pos).alias("pos"), F.lit(role).alias("role"))

    slots = F.array(slot(0, F.col("subj"), "N", "NSUBJ"), slot(1, F.col("verb"), "V", "ROOT"),
                    slot(2, F.col("obj"), "N", "OBJ"), slot(3, F.col("obl"), "N", EXTRA_SLOT_ROLE))
    return wide.select("item_id", F.filter(slots, lambda s: s["lemma"].isNotNull()).alias("slots"))


def items_long(spark: SparkSession, sf_dir: str, wide: DataFrame | None = None) -> DataFrame:
    """Long form ``(item_id, slot, n_slots, lemma, pos, role)`` of ``items_wide``."""
    wide = wide if wide is not None else items_wide(spark, sf_dir)
    return (wide.select("item_id", F.size("slots").alias("n_slots"), F.explode("slots").alias("s"))
            .select("item_id", "s.slot", "n_slots", "s.lemma", "s.pos", "s.role"))


def triples_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(head, dep, raw_rel, freq)`` with words as ``lemma@POS``: the
    corpus triple table before relation mapping (see
    ``operators.counting.triple_counts`` for the scale-aware plan)."""
    from ..operators.counting import triple_counts
    return triple_counts(spark, sf_dir)


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base`` pre-aggregated to ``(verb, subj, filler, raw_rel, cnt)``.

    lineitem meets part once, is counted per (brand, name, supplier, label)
    with a map-side partial aggregate, and only that reduced table meets
    supplier/nation. Part's file is small for its rows, which the merge hint
    keeps from going through the driver."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").hint("merge")
    pre = (li.join(part, li.l_partkey == part.p_partkey)
           .groupBy(F.col("p_brand").alias("verb"),
                    F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("filler"),
                    F.col("l_suppkey").alias("suppkey"),
                    F.concat("l_returnflag", "l_linestatus").alias("raw_rel"))
           .agg(F.count(F.lit(1)).alias("cnt")))
    sn = (table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
          .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
                F.col("s_nationkey") == F.col("n_nationkey"))
          .select(F.col("s_suppkey").alias("suppkey"), F.col("n_name").alias("subj")))
    return (pre.join(sn, "suppkey").groupBy("verb", "subj", "filler", "raw_rel")
            .agg(F.sum("cnt").alias("cnt")))


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigrams_from(base_counts(spark, sf_dir), role_map(spark, sf_dir))


def bigrams_from(b: DataFrame, rm: DataFrame) -> DataFrame:
    """Role-typed argument pairs ``(a1, a2, freq)``, arguments ``l@p@r``:
    subject-verb, verb-filler and subject-filler, with subject relations
    never used as filler roles."""
    bm = b.join(F.broadcast(rm), "raw_rel").where(F.col("role") != "NSUBJ")  # bounded: one row per label
    subj = F.concat(F.col("subj"), F.lit("@N@NSUBJ"))
    verb = F.concat(F.col("verb"), F.lit("@V@ROOT"))
    fill = F.concat(F.col("filler"), F.lit("@N@"), F.col("role"))
    u = (b.select(subj.alias("a1"), verb.alias("a2"), "cnt")
         .unionByName(bm.select(verb.alias("a1"), fill.alias("a2"), "cnt"))
         .unionByName(bm.select(subj.alias("a1"), fill.alias("a2"), "cnt")))
    return u.groupBy("a1", "a2").agg(F.sum("cnt").cast("double").alias("freq"))


def lemma_pos_freqs(spark: SparkSession, sf_dir: str, bg: DataFrame | None = None) -> DataFrame:
    """``(lemma_pos, freq)``: marginal counts of both bigram sides."""
    bg = bg if bg is not None else bigrams(spark, sf_dir)
    strip = lambda c: F.regexp_replace(F.col(c), "@[^@]*$", "")
    u = bg.select(strip("a1").alias("lemma_pos"), "freq").unionByName(
        bg.select(strip("a2").alias("lemma_pos"), "freq"))
    return u.groupBy("lemma_pos").agg(F.sum("freq").alias("freq"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word, vec array<double>)``. Embedding ``vec_id = k`` is the vector
    of filler ``k``; other embeddings get the word ``w<vec_id>``. Embeddings
    with label 0 are left out of the space, so some fillers are out of
    vocabulary."""
    return vectors_from(spark, sf_dir, fillers(spark, sf_dir))


def vectors_from(spark: SparkSession, sf_dir: str, fl: DataFrame) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").where(F.col("label") != 0).select("vec_id", "embedding")
    return (emb.join(fl, emb.vec_id == fl.k, "left")
            .select(F.coalesce(F.col("filler"), F.concat(F.lit("w"), F.col("vec_id").cast("string"))).alias("word"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec")))


TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def toks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus tokens ``(doc_id, pos, tok)``: lower case, every run of
    non-letter/non-digit characters is a separator, whole documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    norm = F.trim(F.regexp_replace(F.lower(F.col("text")), TOKEN_SPLIT, " "))
    return (docs.select("doc_id", F.posexplode(F.split(norm, " ")).alias("pos", "tok"))
            .where(F.col("tok") != ""))


def sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences ``(sent_id, text, word_pos)`` from ``benchmark`` and
    ``conversations``: blank runs become one blank, the text is split on
    ``'. '``. Sentences are numbered in the order of their source, its key, the
    turn and the piece, whatever the size of those numbers. ``word_pos`` is the
    middle word."""
    return sentences_of(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations"))


def sentences_of(benchmark: DataFrame, conversations: DataFrame) -> DataFrame:
    """``sents`` of the two tables."""
    ws = r"[ \t\n\r]+"
    bench = benchmark.select(F.lit(0).alias("kind"), F.col("item_id").cast("long").alias("src_key"), F.lit(0).cast("long").alias("turn"), "text")
    conv = conversations.select(F.lit(1).alias("kind"), F.col("conv_id").cast("long").alias("src_key"), F.col("turn").cast("long"), "text")
    u = spread(bench.unionByName(conv))
    key = ["kind", "src_key", "turn"]
    pieces = u.select(*key, F.posexplode(F.split(F.trim(F.regexp_replace("text", ws, " ")), r"\. ")).alias("i", "text")).where(F.col("text") != "")
    numbered = sentence_index(pieces, [*key, "i", "text"], "sent_id")
    nwords = F.size(F.split(F.col("text"), " "))
    return numbered.select("sent_id", "text", (F.floor(nwords / 2)).cast("int").alias("word_pos"))
