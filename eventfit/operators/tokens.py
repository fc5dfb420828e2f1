"""Token alignment and masking.

Sentences arrive as rows; their pieces are produced as an array per row
(no shuffle) and exploded to ``(sent_id, pos, token)`` with 1-based
positions (position 0 would be the start marker). Windows used for word
grouping are partitioned by sentence, so a task holds one sentence's pieces
at a time.

Mask plans are kept compact: every variant masks one contiguous range
``[mask_from, mask_to]`` (plain: the target; left-to-right: the target and
everything after it; adapted: the target and the later pieces of its own
word), so a sentence of n pieces gives n plan rows, not n * n; ``expand``
produces the explicit per-position form when it is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONT_PREFIX, PIECE_PREFIX, SPECIAL_TOKENS, WORD_MARKER
from ..session import written

PRETOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
PIECE_LEN = 4
SPECIALS = SPECIAL_TOKENS


def pretokens(text: Column) -> Column:
    """Letter/digit runs and single punctuation characters."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), 0)


def _cut(t: Column, first_prefix: Column, cont_prefix: str) -> Column:
    n = F.ceil(F.length(t) / PIECE_LEN).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.concat(F.when(j > 0, F.lit(cont_prefix)).otherwise(first_prefix),
                           t.substr(j * PIECE_LEN + 1, F.lit(PIECE_LEN))))


CUT_MARK = "\u0001"  # internal marker; a control character that text does not carry


def _prefix_pieces(text: Column) -> Column:
    """Prefix-style pieces in two regex passes: words of more than
    ``PIECE_LEN`` letters/digits get the marker and the continuation prefix
    before each further piece, then runs of letters/digits (with the prefix
    behind a marker) and single punctuation characters are extracted, without
    a function on every piece. A letter beyond U+FFFF ends its word."""
    m, any_ = CUT_MARK, r"[a-zA-Z0-9\p{L}\p{N}]"
    near, far = r"[a-zA-Z0-9[\p{L}\p{N}&&[\x{0}-\x{FFFF}]]]", r"[\p{L}\p{N}&&[\x{10000}-\x{10FFFF}]]"
    run = f"(?:{near}++{far}?+|{far})"
    cut = F.regexp_replace(F.replace(text, F.lit(m), F.lit("")), f"{near}{{{PIECE_LEN}}}(?={any_})", "$0" + m + PIECE_PREFIX)
    return F.regexp_extract_all(cut, F.lit(f"{run}|(?<={m}){PIECE_PREFIX}{run}|" + r"[^\p{L}\p{N}\s" + m + "]"), 0)


def pieces(text: Column, style: str = "prefix") -> Column:
    """Sub-word pieces of a text: every pretoken cut into pieces of
    ``PIECE_LEN`` characters. ``prefix`` style marks continuation pieces with
    ``##``; ``marker`` style marks the first piece of every word except the
    first with the word-start marker."""
    if style == "prefix":
        return _prefix_pieces(text)
    pre = pretokens(text)
    if style == "marker":
        def cut(t, i):
            is_word = t.rlike(r"^[\p{L}\p{N}]")
            return _cut(t, F.when((i > 0) & is_word, F.lit(WORD_MARKER)).otherwise(F.lit("")), "")
        return F.flatten(F.transform(pre, cut))
    raise ValueError(style)


def explode_tokens(df: DataFrame, id_col: str, arr_col: str) -> DataFrame:
    """``(id, pos, token)`` with 1-based ``pos``."""
    return (df.select(id_col, F.posexplode(arr_col).alias("p0", "token"))
            .select(id_col, (F.col("p0") + 1).alias("pos"), "token"))


def word_groups_prefix(toks: DataFrame, prefix: str = CONT_PREFIX, id_col: str = "sent_id") -> DataFrame:
    """``word_idx`` (0-based): a piece starting with ``prefix``
    continues the previous word, any other piece starts a new one."""
    start = F.when(F.col("token").startswith(prefix), 0).otherwise(1)
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return toks.withColumn("word_idx", (F.sum(start).over(w) - 1).cast("int"))


def word_groups_marker(toks: DataFrame, marker: str = WORD_MARKER, id_col: str = "sent_id") -> DataFrame:
    """A word starts at the first piece, at special tokens and ``.``, at
    a piece carrying the word-start marker, and right after a ``.`` (a
    period is always a word of its own)."""
    w_ord = Window.partitionBy(id_col).orderBy("pos")
    prev = F.lag("token", 1).over(w_ord)
    start = (F.col("pos") == 1) | F.col("token").isin(*SPECIALS, ".") | F.col("token").startswith(marker) \
        | (F.coalesce(prev, F.lit("")) == ".")
    w = w_ord.rowsBetween(Window.unboundedPreceding, 0)
    return (toks.withColumn("_s", F.when(start, 1).otherwise(0))
            .withColumn("word_idx", (F.sum("_s").over(w) - 1).cast("int")).drop("_s"))


def word_ends(toks: DataFrame, style: str = "prefix", id_col: str = "sent_id") -> DataFrame:
    """``toks(pos, token, n, ...)`` with ``word_end``, the position of the last
    piece of the token's own word (T1 or T2): the piece before the next one
    that starts a word. One window that runs backward over the sentence."""
    w = Window.partitionBy(id_col).orderBy(F.col("pos").desc())
    if style == "prefix":
        start = ~F.col("token").startswith(CONT_PREFIX)
    else:
        start = F.col("token").isin(*SPECIALS, ".") | F.col("token").startswith(WORD_MARKER) \
            | (F.coalesce(F.lead("token", 1).over(w), F.lit("")) == ".")
    t = toks.withColumn("_at", F.when(start, F.col("pos")))
    nxt = F.min("_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn("word_end", F.coalesce(nxt - 1, F.col("n"))).drop("_at")


def mask_range_end(kind: str) -> Column:
    """T3-T5 over rows ``(pos, n, word_end)``: the last position masked for the
    target at ``pos``, which is the first one."""
    ends = {"plain": "pos", "l2r": "n", "adapted": "word_end"}
    return F.col(ends[kind])


def mask_plan(toks_with_words: DataFrame, kind: str, id_col: str = "sent_id") -> DataFrame:
    """T3/T4/T5 (and T10): one variant per target piece,
    ``(sent_id, target_pos, token, mask_from, mask_to)``."""
    t = toks_with_words
    if kind == "plain":
        to = F.col("pos")
    elif kind == "l2r":
        to = F.col("n") if "n" in t.columns else F.max("pos").over(Window.partitionBy(id_col))
    elif kind == "adapted":
        to = F.max("pos").over(Window.partitionBy(id_col, "word_idx"))
    else:
        raise ValueError(kind)
    return t.select(id_col, F.col("pos").alias("target_pos"), "token",
                    F.col("pos").alias("mask_from"), to.alias("mask_to"))


def expand(plan: DataFrame, n_col: str = "n", id_col: str = "sent_id") -> DataFrame:
    """Explicit form of a compact plan: ``(sent_id, target_pos, pos,
    masked)`` for every position of every variant (needs ``n``)."""
    return (plan.select(id_col, "target_pos", "mask_from", "mask_to", F.explode(F.sequence(F.lit(1), F.col(n_col))).alias("pos"))
            .select(id_col, "target_pos", "pos",
                    F.col("pos").between(F.col("mask_from"), F.col("mask_to")).alias("masked")))


def locate_span(sent_pieces: Column, word_pieces: Column, last: bool = False) -> Column:
    """1-based start of the word's pieces in the sentence: the first
    position where the whole piece sequence matches (the last one with
    ``last=True``, e.g. for the sentence's last word); if none matches
    fully, the last position holding the first piece; NULL when that never
    occurs."""
    k = F.size(word_pieces)
    cands = F.filter(F.sequence(F.lit(1), F.greatest(F.size(sent_pieces), F.lit(1))),
                     lambda i: F.try_element_at(sent_pieces, i) == F.try_element_at(word_pieces, F.lit(1)))
    full = F.filter(cands, lambda i: F.slice(sent_pieces, i, k) == word_pieces)
    return F.coalesce(F.try_element_at(full, F.lit(-1 if last else 1)), F.try_element_at(cands, F.lit(-1)))


def span_score(token_scores: DataFrame, spans: DataFrame, average: bool = True, id_col: str = "sent_id") -> DataFrame:
    """Sum (or mean over the span length) of the token scores at
    positions ``start .. start+k-1``; ``spans`` is ``(sent_id, start, k)``.
    Rows without a span keep a NULL score."""
    s = spans.alias("s")
    t = token_scores.select(F.col(id_col).alias("_sid"), F.col("target_pos").alias("pos"), "logprob")
    # equi-join on the sentence, residual range on the position: a sentence's
    # span is matched against that sentence's pieces only
    j = s.join(t.hint("merge"), (F.col(f"s.{id_col}") == F.col("_sid")) &
               F.col("pos").between(F.col("s.start"), F.col("s.start") + F.col("s.k") - 1), "left")
    agg = j.groupBy(F.col(f"s.{id_col}").alias(id_col), "s.k").agg(F.sum("logprob").alias("total"))
    val = F.try_divide(F.col("total"), F.col("k")) if average else F.col("total")
    return agg.select(id_col, val.alias("score"))


def log_normaliser(logits: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., _lse)``: ``log sum exp(logit)`` per key, summed in two
    levels: per key and whole part of the logit (shifted by it, so nothing
    overflows; a hot key is combined inside the map tasks), then over the parts
    of a key, as many as its logits have whole parts."""
    parts = (logits.withColumn("_e", F.floor("logit").cast("double")).groupBy(*keys, "_e")
             .agg(F.sum(F.exp(F.col("logit") - F.col("_e"))).alias("_s"))
             .groupBy(*keys).agg(F.max("_e").alias("_m"), F.collect_list(F.struct("_e", "_s")).alias("_p")))
    shifted = F.aggregate("_p", F.lit(0.0), lambda acc, x: acc + x["_s"] * F.exp(x["_e"] - F.col("_m")))
    return parts.select(*keys, (F.col("_m") + F.log(shifted)).alias("_lse"))


def log_softmax_gather(logits: DataFrame, targets: DataFrame, keys: list[str], normaliser: DataFrame | None = None) -> DataFrame:
    """``logit(target) - log sum exp(logit)`` per key, max-shifted.

    ``logits`` is ``(keys..., cand, logit)``, ``targets`` ``(keys...,
    target)``. The normaliser (``log_normaliser``) is written, here or by the
    caller, so that a hot key can be split in the join. NULL when the target
    is not a candidate."""
    lse = written(log_normaliser(logits, keys), "log_sum_exp") if normaliser is None else normaliser
    tl = targets.join(logits.withColumnRenamed("cand", "target"), keys + ["target"], "left")
    return tl.join(lse, keys, "left").select(*keys, "target", (F.col("logit") - F.col("_lse")).alias("logprob"))


def token_count(sent_pieces: Column) -> tuple[Column, Column]:
    """Pieces without specials, and with the two end markers."""
    n = F.size(F.filter(sent_pieces, lambda t: ~t.isin(*SPECIALS)))
    return n, n + 2
