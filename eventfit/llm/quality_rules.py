"""Quality rules with adaptive thresholds, with DataFrame operations only.

Each document gets a few counts. Their distribution per language and source
is held in a mergeable quantile sketch: counts of logarithmic buckets, which
give every quantile within a fixed relative error, and which merge by adding
(so partial sketches combine before the shuffle, and sketches of small groups
merge into those of their language and of everything). Thresholds are fences
around the quartiles; the documents are joined with those of their group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

#: White space between words, and its members for trimming and deleting.
SPACE, SPACES = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Ratio of neighbouring bucket bounds: quantiles are right within one per cent.
GAMMA = 1.02
#: Rows that a group must have for thresholds of its own.
LEAST_ROWS = 100


@dataclass(frozen=True)
class Metric:
    """``value``: SQL over the counts, a whole number of millionths. The fence lies ``reach`` times the distance
    of the quartiles (``spread`` at least) outside them; ``both``: also below."""

    name: str
    value: str
    spread: int
    both: bool = False
    reach: int = 4


METRICS = (
    Metric("symbols", "n_symbols * 1000000 div greatest(word_chars, 1)", 10_000),
    Metric("upper", "n_upper * 1000000 div greatest(word_chars, 1)", 25_000),
    Metric("dup_lines", "n_dup_lines * 1000000 div greatest(n_lines, 1)", 150_000),
    Metric("word_length", "word_chars * 1000000 div greatest(n_words, 1)", 600_000, True),
)


def measure(docs: DataFrame, out: str = "counts") -> DataFrame:
    """``docs`` with a struct column of counts of the whole ``text``; null counts as empty."""
    step = [f"{out}_{x}" for x in ("words", "lines", "windows", "pairs")]
    words, lines, windows, pairs = step
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumns({
        words: F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)),
        lines: F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
    })
    n = F.size(words)
    df = df.withColumn(windows, F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))))
    # only texts with a repeated window are looked at closer: windows by hash, then the places of equal neighbours
    df = df.withColumn(pairs, F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.col(pairs)
    repeated = F.sort_array(F.transform(
        F.filter(at, lambda p, k: (F.get(at, k - 1)["h"] == p["h"]) | (F.get(at, k + 1)["h"] == p["h"])), lambda p: p["i"]))
    covered = F.aggregate(repeated, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    size = F.length(text)
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (size - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(at.isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        (size - F.length(F.translate(text, UPPER, ""))).cast("long").alias("n_upper"),
        F.size(lines).cast("long").alias("n_lines"))
    # generated rather than projected, so that no later filter copies these expressions into itself
    return df.select(*docs.columns, F.explode_outer(F.array(counts)).alias(out))


def base_failed(counts: str = "counts") -> Column:
    c = F.col(counts)
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def sketches(counted: DataFrame) -> DataFrame:
    """``lang, source, metric, bucket, n`` for ``counted(lang, source, counts)``: a sketch per group and metric.

    Bucket 0 holds the value 0; bucket b > 0 the values in (GAMMA^(b-2), GAMMA^(b-1)].
    """
    flat = counted.select("lang", "source", "counts.*")
    values = F.array(*[F.struct(F.lit(m.name).alias("metric"), F.expr(m.value).alias("v")) for m in METRICS])
    long = flat.select("lang", "source", F.inline(values))
    bucket = F.when(F.col("v") <= 0, 0).otherwise(1 + F.ceil(F.log(F.col("v").cast("double")) / F.log(F.lit(GAMMA)))).cast("int")
    return long.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and quartiles of each sketch; a window holds the buckets of one sketch, at most a few hundred."""
    w = Window.partitionBy(*keys, "metric")
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 1))
    ranked = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "rows": F.sum("n").over(w), "value": value})
    return ranked.groupBy(*keys, "metric").agg(
        F.first("rows").alias("rows"),
        F.min(F.when(4 * F.col("upto") >= F.col("rows"), F.col("value"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("rows"), F.col("value"))).alias("q3"))


def thresholds(counted: DataFrame) -> DataFrame:
    """``lang, source`` with the fences ``<metric>_low`` and ``<metric>_high`` of every metric.

    Groups of fewer than ``LEAST_ROWS`` rows use the merged sketch of their
    language, and failing that the one of all rows.
    """
    own = settle(sketches(counted), "sketches")
    per_lang = own.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    everything = per_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    fine = _quartiles(own, ["lang", "source"])
    mid = _quartiles(per_lang, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("lm"), F.col("rows").alias("lr"),
                                                F.struct("q1", "q3").alias("lq"))
    top = _quartiles(everything, []).select(F.col("metric").alias("tm"), F.struct("q1", "q3").alias("tq"))
    all_ = (fine.join(mid, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("lm")))
            .join(top, F.col("metric") == F.col("tm")))
    q = F.when(F.col("rows") >= LEAST_ROWS, F.struct("q1", "q3")).when(F.col("lr") >= LEAST_ROWS, F.col("lq")).otherwise(F.col("tq"))
    all_ = all_.select("lang", "source", "metric", q.alias("q"))
    cols = []
    for m in METRICS:
        own_q = F.max(F.when(F.col("metric") == m.name, F.col("q")))
        reach = m.reach * F.greatest(own_q["q3"] - own_q["q1"], F.lit(float(m.spread)))
        cols.append((own_q["q3"] + reach).alias(f"{m.name}_high"))
        if m.both:
            cols.append((own_q["q1"] - reach).alias(f"{m.name}_low"))
    return settle(all_.groupBy("lang", "source").agg(*cols), "thresholds")


def judge(counted: DataFrame, fences: DataFrame) -> DataFrame:
    """``counted(lang, source, counts, ...)`` with ``base_failed``, the metrics that lie outside, and ``kept``.

    The fences are joined by language and source (null is a group like any
    other); how is left to Spark, which broadcasts them while they measure small
    and splits a hot source otherwise.
    """
    f = fences.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), F.struct(*[
        c for c in fences.columns if c not in ("lang", "source")]).alias("fences"))
    both = counted.join(f, F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source")), "left")
    outside = []
    for m in METRICS:
        v = F.expr(_on_struct(m.value))
        out = v > F.col(f"fences.{m.name}_high")
        if m.both:
            out = out | (v < F.col(f"fences.{m.name}_low"))
        outside.append(F.when(out, F.lit(m.name)))
    both = both.withColumns({"base_failed": base_failed(), "outside": F.array_compact(F.array(*outside))})
    return both.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0)).drop("fence_lang", "fence_source", "fences")


def _on_struct(value: str) -> str:
    for name in ("n_symbols", "word_chars", "n_upper", "n_dup_lines", "n_lines", "n_words"):
        value = value.replace(name, f"counts.{name}")
    return value


def rate_documents(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row of ``docs(doc_id, text, lang, source)``.

    Returns ``doc_id``, the counts, ``base_failed``, ``outside`` and ``kept``.
    Null and empty texts have no words and fail the base rules; null languages
    and sources are groups of their own; a value on a fence is kept; repeated
    rows are judged alike; a very long text is one row's work; other columns
    are ignored; an empty table gives an empty result.
    """
    counted = settle(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality_counts")
    return judge(counted, thresholds(counted)).select("doc_id", "counts.*", "base_failed", "outside", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns as they were.

    Each row is judged by itself, as by ``rate_documents``, whatever its id.
    Texts are measured once: the counts are written beside their rows, and the
    thresholds are made from the counts alone.
    """
    whole = docs.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))
    counted = settle(measure(whole).drop("text"), "quality_counts")
    return judge(counted, thresholds(counted)).where("kept").select("whole_row.*")
