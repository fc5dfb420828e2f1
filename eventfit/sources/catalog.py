"""Derived corpus tables, written once per session into the shared folder.

The reference loads precomputed frequency tables, items and vectors from
files; here they are Spark jobs over the driver tables (``fixtures``), and
each is materialised once as parquet under ``spark.checkpoint.dir`` and read
back. That cuts the lineage (a lost executor re-reads the written table
instead of recomputing the star join), keeps every downstream plan small,
and gives the scans of these tables column pruning and filter pushdown.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LEMMA_MIN_FREQ, PAIR_MIN_FREQ, TF_CENTROID_SIZE, TF_LIST_LENGTH, TRIPLE_MIN_FREQ
from ..constants import PAIR_WINDOW as PAIR_WINDOW_
from ..operators import counting as cnt
from ..session import scratch_path
from . import fixtures as fx

_WRITTEN: dict[tuple[str, str, str], str] = {}
_LOCKS: dict[tuple[str, str, str], threading.Lock] = {}
_REGISTRY_LOCK = threading.Lock()

LEMMA_MIN, PAIR_MIN, PAIR_WINDOW, TRIPLE_MIN = LEMMA_MIN_FREQ, PAIR_MIN_FREQ, PAIR_WINDOW_, TRIPLE_MIN_FREQ
#: Characters of the sentences dealt to one bucket: its pieces are sorted in a task's memory, whatever the size of the table.
BUCKET_CHARS = 1_500_000
#: Of the written tables: read once or a few times each, most of their bytes are repeated pieces and numbers.
CODEC = "zstd"


def materialized(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], dealt_by: tuple[str, ...] = (),
                 buckets: Callable[[], int] | None = None) -> DataFrame:
    """The table ``name``, written when first asked for.

    With ``dealt_by`` it is bucketed by these columns, into ``buckets()`` parts or
    as many as there are shuffle partitions: joins and aggregates on them need no
    shuffle. The session's catalog then knows it by a name of its own."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    with _REGISTRY_LOCK:
        lock = _LOCKS.setdefault(key, threading.Lock())
    # one builder per table; a thread needing a table another thread is
    # building waits for it (tables depend on each other as a DAG)
    with lock:
        path = _WRITTEN.get(key)
        if path is None:
            path = scratch_path(spark, f"tables/{name}")
            if dealt_by:
                parts = buckets() if buckets else int(spark.conf.get("spark.sql.shuffle.partitions"))
                known = f"eventfit_{name}_{uuid.uuid4().hex}"
                build().write.bucketBy(parts, *dealt_by).options(path=path, compression=CODEC).format("parquet").saveAsTable(known)
                path = known
            else:
                build().write.mode("overwrite").parquet(path, compression=CODEC)
            _WRITTEN[key] = path
    return spark.table(path) if dealt_by else spark.read.parquet(path)


def forget(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Build the tables of ``sf_dir`` (all if None) anew when they are next
    asked for, as is needed after its files have changed."""
    sf_dir = sf_dir and sf_dir.rstrip("/")
    with _REGISTRY_LOCK:
        for key in [k for k in _WRITTEN if k[0] == spark.sparkContext.applicationId and sf_dir in (None, k[1])]:
            del _WRITTEN[key]


def _table(name: str, build: Callable[[SparkSession, str], DataFrame], *dealt_by: str, buckets: Callable[[SparkSession, str], int] | None = None):
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        return materialized(spark, sf_dir, name, lambda: build(spark, sf_dir), dealt_by, buckets and (lambda: buckets(spark, sf_dir)))
    get.__name__ = name
    get.__doc__ = f"Materialised ``{name}`` (see ``fixtures``)."
    return get


fillers = _table("fillers", fx.fillers)
role_map = _table("role_map", fx.role_map)
items_wide = _table("items_wide", lambda s, d: fx.items_wide_from(s, d, fillers(s, d)))
triples_raw = _table("triples_raw", fx.triples_raw)
triples = _table("triples", lambda s, d: cnt.map_triples(triples_raw(s, d), role_map(s, d), min_freq=float(TRIPLE_MIN)))
# read three times by the bigrams
base_counts = _table("base_counts", fx.base_counts)
bigrams = _table("bigrams", lambda s, d: fx.bigrams_from(base_counts(s, d), role_map(s, d)))
lemma_pos_freqs = _table("lemma_pos_freqs", lambda s, d: fx.lemma_pos_freqs(s, d, bigrams(s, d)))
vectors = _table("vectors", lambda s, d: fx.vectors_from(s, d, fillers(s, d)))
toks = _table("toks", fx.toks)
sents = _table("sents", fx.sents)
lemmas = _table("lemmas", lambda s, d: cnt.lemma_counts(toks(s, d), LEMMA_MIN))
# the pair table the pair baseline loads: forward pairs within PAIR_WINDOW
# of lemmas with at least LEMMA_MIN occurrences, kept from PAIR_MIN on
pairs = _table("pairs", lambda s, d: cnt.window_pair_counts(toks(s, d), lemmas(s, d), PAIR_WINDOW, PAIR_MIN))


def items_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.items_long(spark, sf_dir, items_wide(spark, sf_dir))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import spread, table
    return spread(table(spark, sf_dir, "documents").select("text"))


def _piece_bigrams(style: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..plans.lmscore import corpus_piece_bigrams
        return corpus_piece_bigrams(_docs(spark, sf_dir), style)
    return build


def _piece_unigrams(bi):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..plans.lmscore import corpus_piece_unigrams
        return corpus_piece_unigrams(bi(spark, sf_dir), _docs(spark, sf_dir))
    return build


piece_bigrams = _table("piece_bigrams", _piece_bigrams("prefix"), "prev", "w")
piece_unigrams = _table("piece_unigrams", _piece_unigrams(piece_bigrams))
piece_bigrams_marker = _table("piece_bigrams_marker", _piece_bigrams("marker"), "prev", "w")
piece_unigrams_marker = _table("piece_unigrams_marker", _piece_unigrams(piece_bigrams_marker))


def sentence_buckets(spark: SparkSession, sf_dir: str) -> int:
    """Into how many parts sentences and their tokens are dealt: the shuffle partitions, more if these would hold too much."""
    chars = sents(spark, sf_dir).agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))


def _lm_sents(style: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..plans.lmscore import lm_sentences
        # cut behind the shuffle, which then moves the texts only
        return lm_sentences(sents(spark, sf_dir).repartition(sentence_buckets(spark, sf_dir), "sent_id"), style)
    return build


lm_sents = _table("lm_sents", _lm_sents("prefix"), "sent_id", buckets=sentence_buckets)
lm_sents_marker = _table("lm_sents_marker", _lm_sents("marker"), "sent_id", buckets=sentence_buckets)


def _tf_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans import sweep
    from ..plans import thematic as tf
    keys = tf.distinct_keys(tf.item_keys(items_wide(spark, sf_dir)))
    return sweep.key_table(keys, tf.attested_contexts(keys, bigrams(spark, sf_dir)))


def tf_inputs(spark: SparkSession, sf_dir: str):
    from ..plans import thematic as tf
    return tf.TFInputs(items_wide(spark, sf_dir), bigrams(spark, sf_dir), lemma_pos_freqs(spark, sf_dir), vectors(spark, sf_dir))


#: Context keys with their attested contexts; the probes and every model read it.
tf_keys = _table("tf_keys", _tf_keys)


def tf_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf_keys(spark, sf_dir).select("t_role", F.explode("ws").alias("w")).distinct()


def tf_lists(spark: SparkSession, sf_dir: str, weight: str = "lmi") -> DataFrame:
    """P3 output for every probe (attested context, target role) of the
    items: ``(w, t_role, filler, role, weight)``, whole lists."""
    def build() -> DataFrame:
        from ..plans import thematic as tf
        return tf.filler_lists(tf_probes(spark, sf_dir), tf_inputs(spark, sf_dir), tf.TFParams(weight=weight))
    return materialized(spark, sf_dir, f"tf_lists_{weight}", build)


def _tf_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans import fillers
    from ..plans import thematic as tf
    return fillers.candidate_index(bigrams(spark, sf_dir), lemma_pos_freqs(spark, sf_dir), tf.vector_words(vectors(spark, sf_dir)),
                                   lambda c: tf.filler_vkey(c, False))[0]


def _tf_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans import fillers as fl
    return fl.block_headers(tf_index(spark, sf_dir))


tf_index = _table("tf_index", _tf_index)
tf_headers = _table("tf_headers", _tf_headers)


def tf_ranked(spark: SparkSession, sf_dir: str, weight: str = "lmi", n: int = TF_LIST_LENGTH, m: int = TF_CENTROID_SIZE) -> DataFrame:
    """The best ``n`` fillers of every probe and the best ``m`` with a vector,
    as ranked arrays (``plans.fillers``). Every setting up to these sizes reads
    prefixes of them."""
    def build() -> DataFrame:
        from ..plans import fillers as fl
        best, _ = fl.best_fillers(tf_index(spark, sf_dir), tf_headers(spark, sf_dir), tf_probes(spark, sf_dir),
                                  lemma_pos_freqs(spark, sf_dir), weight, n, m)
        return fl.ranked_arrays(best)
    return materialized(spark, sf_dir, f"tf_ranked_{weight}_{n}_{m}", build)


def _lm_pairs(sentences, uni, bi):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..plans import lmscore as lm
        return lm.pair_table(lm.sentence_tokens(sentences(spark, sf_dir)), uni(spark, sf_dir), bi(spark, sf_dir))
    return build


def _lm_feats(sentences, pairs, uni, style: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..plans.lmscore import pair_features
        # no query asks for a piece's own log-probability
        return pair_features(sentences(spark, sf_dir), pairs(spark, sf_dir), uni(spark, sf_dir), style, sentence_buckets(spark, sf_dir)).drop("uni")
    return build


def _lm_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tokens import log_normaliser
    return log_normaliser(continuation_logits(spark, sf_dir), ["prev"])


def continuation_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(prev, cand, logit)``: the corpus continuations of every piece, logit ln(count + 1)."""
    return piece_bigrams(spark, sf_dir).select("prev", F.col("w").alias("cand"), F.log(F.col("c") + 1).alias("logit"))


lm_pairs = _table("lm_pairs", _lm_pairs(lm_sents, piece_unigrams, piece_bigrams))
lm_pairs_marker = _table("lm_pairs_marker", _lm_pairs(lm_sents_marker, piece_unigrams_marker, piece_bigrams_marker))
lm_feats = _table("lm_feats", _lm_feats(lm_sents, lm_pairs, piece_unigrams, "prefix"), "sent_id", buckets=sentence_buckets)
lm_feats_marker = _table("lm_feats_marker", _lm_feats(lm_sents_marker, lm_pairs_marker, piece_unigrams_marker, "marker"), "sent_id",
                         buckets=sentence_buckets)
lm_normaliser = _table("lm_normaliser", _lm_normaliser)


def prepare(spark: SparkSession, sf_dir: str, threads: int = 4) -> None:
    """Build every shared table, independent ones as concurrent Spark jobs
    (many of the builds are short jobs whose latency then overlaps)."""
    getters = [toks, piece_unigrams, items_wide, bigrams, triples, sents, vectors, lemma_pos_freqs, lemmas,
               pairs, lm_sents, lm_feats, lm_normaliser, tf_lists, tf_ranked]
    with ThreadPoolExecutor(max_workers=threads) as ex:
        for f in [ex.submit(g, spark, sf_dir) for g in getters]:
            f.result()


def tf_models(spark: SparkSession, sf_dir: str, params) -> DataFrame:
    """The thematic-fit models of several settings of one weight function, from one pass (``plans.sweep``)."""
    from ..plans import sweep
    weight, = {p.weight for p in params}
    n, m = max(TF_LIST_LENGTH, *(p.list_length for p in params)), max(TF_CENTROID_SIZE, *(p.n_centroid for p in params))
    return sweep.models(tf_keys(spark, sf_dir), tf_ranked(spark, sf_dir, weight, n, m), params)


def tf_model(spark: SparkSession, sf_dir: str, params) -> DataFrame:
    """The thematic-fit model of the items for one parameter set, written
    once: per context key the operation and the chosen prototype fillers.
    Scores, filler reports, centroids and the combined score all read it."""
    sig = f"{params.list_length}_{params.n_centroid}_{params.weight}_{params.update}_{int(params.exact_mean)}"
    return materialized(spark, sf_dir, f"tf_model_{sig}", lambda: tf_models(spark, sf_dir, [params]))
