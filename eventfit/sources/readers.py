"""Text-format sources of the reference (S1-S14), read with Spark readers.

Every reader is a scan plus column expressions. "The later line wins" rules
use the line order taken right at the scan: folder, number of the part file
(as a number, so that part 100000 follows part 99999), file name, offset of
the block in its file, and the running id inside the block.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import with_scalars
from ..session import scratch_path, written

SENTENCE_SCHEMA = T.StructType([T.StructField("sent_id", T.LongType()), T.StructField("text", T.StringType()),
                                T.StructField("word_pos", T.IntegerType())])


def line_order() -> Column:
    """The place of a text line among all lines of a path, as a struct that sorts."""
    name, path = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    return F.struct(F.regexp_replace(path, "/[^/]*$", "").alias("folder"),
                    F.regexp_extract(name, r"(\d+)", 1).try_cast("long").alias("number"), name.alias("name"),
                    F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def lines(spark: SparkSession, path: str, **opts) -> DataFrame:
    """``(line, ord)``: text lines with their file order (gz read
    transparently)."""
    return spark.read.options(**opts).text(path).select(F.col("value").alias("line"), line_order().alias("ord"))


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)``: the lines of a report numbered from 0 in file
    order. One packed copy keeps each line's place, so no line is shuffled:
    its number is its place in its block plus the lines of all earlier blocks
    (a table with one row per block)."""
    copy = scratch_path(spark, "numbered_lines")
    lines(spark, path).select("line", "ord.*").write.parquet(copy, compression="zstd")
    kept = spark.read.schema("line string, folder string, number long, name string, block long, row long").parquet(copy)
    block = ["folder", "name", "block"]  # the number is part of the name
    per = kept.groupBy(*block, "number").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    earlier = F.sum("n").over(Window.orderBy("folder", "number", "name", "block").rowsBetween(Window.unboundedPreceding, -1))
    at = per.select(*block, (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"))
    return kept.join(F.broadcast(at), block).select((F.col("row") + F.col("shift")).alias("line_no"), "line")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Headerless TSV ``id, text, word_pos``; quoting off so that quote
    characters in sentences are kept as they are."""
    return (spark.read.schema(SENTENCE_SCHEMA).option("sep", "\t").option("quote", "")
            .option("header", "false").csv(path))


def read_role_items(spark: SparkSession, path: str) -> DataFrame:
    """``id \\t lemma@POS@ROLE ...`` of variable width -> long rows
    ``(item_id, slot, lemma, pos, role, is_target)``; the last item of a
    line is the target, the others are its contexts."""
    parts = F.split(F.col("line"), "\t")
    df = lines(spark, path).where(F.trim("line") != "").select(
        F.element_at(parts, 1).cast("long").alias("item_id"),
        F.slice(parts, 2, F.size(parts) - 1).alias("items"))
    df = df.select("item_id", F.size("items").alias("n"), F.posexplode("items").alias("slot", "it"))
    p = F.split(F.col("it"), "@")
    return df.select("item_id", "slot", F.get(p, 0).alias("lemma"), F.get(p, 1).alias("pos"),
                     F.get(p, 2).alias("role"), (F.col("slot") == F.col("n") - 1).alias("is_target"))


def read_role_map(spark: SparkSession, path: str) -> DataFrame:
    """S3: lines ``ROLE raw,raw,...`` -> inverse map ``(raw_rel, role)``; a
    raw label listed again on a later line is mapped by that later line."""
    tok = F.split(F.trim(F.col("line")), r"\s+")
    df = (lines(spark, path).where(F.trim("line") != "")
          .select(F.element_at(tok, 1).alias("role"), F.split(F.element_at(tok, 2), ",").alias("raws"), "ord"))
    inv = df.select("role", F.explode("raws").alias("raw_rel"), "ord")
    return inv.groupBy("raw_rel").agg(F.max_by("role", "ord").alias("role"))


def read_role_lists(spark: SparkSession, path: str) -> DataFrame:
    """S3 forward: ``(role, raws array<string>)`` as listed; a role on a later
    line again is given by that line."""
    tok = F.split(F.trim(F.col("line")), r"\s+")
    df = lines(spark, path).where(F.trim("line") != "").select(
        F.element_at(tok, 1).alias("role"), F.split(F.element_at(tok, 2), ",").alias("raws"), "ord")
    return df.groupBy("role").agg(F.max_by("raws", "ord").alias("raws"))


def read_triples(spark: SparkSession, path: str, role_map: DataFrame, min_freq: float = 0.0) -> DataFrame:
    """``head dep rel \\t freq`` -> ``(head, dep, role, freq)``: minimum
    frequency at the scan, raw relation mapped (unmapped dropped; the map is
    one row per label, broadcast), repeated key: the later line wins."""
    parts = F.split(F.col("line"), "\t")
    df = lines(spark, path).select(F.split(F.element_at(parts, 1), " ").alias("k"),
                                   F.element_at(parts, 2).cast("double").alias("freq"), "ord")
    df = df.where(F.col("freq") >= min_freq).select(
        F.get("k", 0).alias("head"), F.get("k", 1).alias("dep"), F.get("k", 2).alias("raw_rel"), "freq", "ord")
    m = df.join(F.broadcast(role_map), "raw_rel")
    return m.groupBy("head", "dep", "role").agg(F.max_by("freq", "ord").alias("freq"))


def read_lemma_pos(spark: SparkSession, path: str) -> DataFrame:
    """``lemma POS \\t freq`` -> ``(lemma, pos, freq)``, later line wins."""
    parts = F.split(F.col("line"), "\t")
    k = F.split(F.element_at(parts, 1), " ")
    df = lines(spark, path).select(F.get(k, 0).alias("lemma"), F.get(k, 1).alias("pos"),
                                   F.element_at(parts, 2).cast("double").alias("freq"), "ord")
    return df.groupBy("lemma", "pos").agg(F.max_by("freq", "ord").alias("freq"))


def read_lemma_sum(spark: SparkSession, path: str) -> DataFrame:
    """``word[ word] \\t freq`` -> ``(words array<string>, freq,
    n_total)``: repeated keys are added; a key with a blank is a tuple; the
    grand total comes along as a column. The text is scanned once: the total
    is that of the grouped table, which is written."""
    parts = F.split(F.col("line"), "\t")
    df = lines(spark, path).select(F.split(F.element_at(parts, 1), " ").alias("words"),
                                   F.element_at(parts, 2).cast("double").alias("freq"))
    g = written(df.groupBy("words").agg(F.sum("freq").alias("freq")), "lemma_sum")
    return with_scalars(g, g.agg(F.sum("freq").alias("n_total")))


def read_bigrams(spark: SparkSession, path: str, role_map: DataFrame) -> DataFrame:
    """``l@p@raw l@p@raw \\t freq`` -> ``(a1, a2, freq)`` with both raw
    relations mapped to roles; a line with an unmapped relation is dropped;
    repeated mapped key: the later line wins."""
    parts = F.split(F.col("line"), "\t")
    k = F.split(F.element_at(parts, 1), " ")
    df = lines(spark, path).select(F.get(k, 0).alias("x1"), F.get(k, 1).alias("x2"),
                                   F.element_at(parts, 2).cast("double").alias("freq"), "ord")
    rm = F.broadcast(role_map)

    def mapped(df, side):
        p = F.split(F.col(side), "@")
        df = df.withColumn("raw_rel", F.get(p, 2)).join(rm, "raw_rel")
        return df.withColumn(side, F.concat_ws("@", F.get(p, 0), F.get(p, 1), F.col("role"))).drop("raw_rel", "role")

    m = mapped(mapped(df, "x1"), "x2")
    return m.groupBy(F.col("x1").alias("a1"), F.col("x2").alias("a2")).agg(F.max_by("freq", "ord").alias("freq"))


def vector_header(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """The first line ``n dim`` of the first file and its ``dim``; None for an
    empty path. One row is read."""
    def place(file: str) -> tuple:
        folder, _, name = file.rpartition("/")
        number = re.search(r"\d+", name)
        return folder, -1 if number is None else int(number[0]), name

    for file in sorted(spark.read.text(path).inputFiles(), key=place):
        first = spark.read.text(file).first()
        if first is not None:
            fields = first[0].split()
            if len(fields) != 2 or not all(x.isdigit() for x in fields):
                raise ValueError(f"no header 'n dim' in {file}")
            return first[0], int(fields[1])
    return None


def read_vectors(spark: SparkSession, path: str, vocab: DataFrame | None = None, k: int = -1,
                 from_end: bool = False) -> DataFrame:
    """Text vectors with a ``n dim`` header; a word may contain blanks
    (everything before the last ``dim`` fields); optional vocabulary filter
    (semi join); optional truncation to ``k`` dimensions - the first ``k``
    by default, the last ``k`` with ``from_end=True`` (what the original text
    loader does); lines whose numbers do not parse are dropped.

    The header is the first line and read as such. Among vectors it is no
    candidate, as it leaves no word before its numbers; only a space of one
    dimension can hold a vector line that looks like it, so there the first
    of the equal lines is left out by its place."""
    head = vector_header(spark, path)
    if head is None:
        return spark.createDataFrame([], "word string, vec array<double>")
    header, dim = head
    ln = lines(spark, path)
    if dim == 1:
        first = ln.where(F.col("line") == header).agg(F.min("ord").alias("o"))
        ln = ln.where((F.col("line") != header) | (F.col("ord") > first.select("o").scalar()))
    t = F.split(F.trim("line"), " ")
    body = ln.select(t.alias("t")).where(F.size("t") > dim).select(
        F.array_join(F.slice("t", 1, F.size("t") - dim), " ").alias("word"),
        F.transform(F.slice("t", F.size("t") - dim + 1, F.lit(dim)), lambda x: x.try_cast("double")).alias("vec"))
    body = body.where(F.forall("vec", lambda x: x.isNotNull()) & (F.col("word") != ""))
    if vocab is not None:
        body = body.join(vocab.select(F.col("word")), "word", "left_semi")
    if k > 0:
        body = body.withColumn("vec", F.slice("vec", -k, k) if from_end else F.slice("vec", 1, k))
    return body


def read_surprisal(spark: SparkSession, path: str) -> DataFrame:
    """Token surprisal TSV with a header; rows whose ids do not parse
    (the terminal escape line at the end) are dropped."""
    raw = (spark.read.option("sep", "\t").option("header", "true").option("quote", "")
           .schema("sentence_id string, token_id string, token string, surprisal string").csv(path))
    return raw.select(F.col("sentence_id").try_cast("long").alias("sentence_id"),
                      F.col("token_id").try_cast("int").alias("token_id"), "token",
                      F.col("surprisal").try_cast("double").alias("surprisal")).where(
        F.col("sentence_id").isNotNull() & F.col("token_id").isNotNull())


def read_original(spark: SparkSession, path: str) -> DataFrame:
    """``id, text, label, deps`` TSV with CRLF line ends."""
    parts = F.split(F.regexp_replace(F.col("line"), "\r$", ""), "\t")
    return lines(spark, path).where(F.trim("line") != "").select(
        F.element_at(parts, 1).cast("long").alias("item_id"), F.element_at(parts, 2).alias("text"),
        F.element_at(parts, 3).alias("label"), F.element_at(parts, 4).alias("deps"))


MATRIX_KEYS = ("dataset", "model", "metric", "norm")


def read_score_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Many score files as one table, with 3 (``id, text, score``) or 5
    columns (plus ``n_tokens, n_words``).

    Below partition folders ``dataset=../model=../metric=../norm=..`` those four
    are the source's own partition columns, so a filter on them skips whole
    folders. Without such folders they are taken from the name of the file, or
    of the folder that holds its parts: ``dataset.model.metric[.norm].txt``."""
    df = spark.read.text(path)
    if all(k in df.columns for k in MATRIX_KEYS):
        # names stay as they are written, also those that look like numbers
        schema = T.StructType([T.StructField(c, T.StringType()) for c in ("value", *MATRIX_KEYS)])
        df, keys = spark.read.schema(schema).text(path), [F.col(k) for k in MATRIX_KEYS]
    else:
        if not path.endswith(".txt") and not df.inputFiles():
            df = spark.read.text(f"{path.rstrip('/')}/*.txt")
        # by substring: an expression that searches the whole path, on every line, took most of the time
        fp = F.col("_metadata.file_path")
        stem = lambda name: F.when(name.endswith(".txt"), F.left(name, F.length(name) - 4)).otherwise("")
        held = stem(F.substring_index(F.substring_index(fp, "/", -2), "/", 1))
        nm = F.split(F.when(held != "", held).otherwise(stem(F.substring_index(fp, "/", -1))), r"\.")
        keys = [F.get(nm, i) for i in range(3)] + [F.coalesce(F.get(nm, 3), F.lit("none"))]
    c = F.split(F.col("value"), "\t")
    return df.where(F.trim("value") != "").select(
        *[v.alias(k) for k, v in zip(MATRIX_KEYS, keys, strict=True)],
        F.get(c, 0).cast("long").alias("id"), F.get(c, 1).alias("text"),
        F.get(c, 2).try_cast("double").alias("score"),
        F.get(c, 3).try_cast("int").alias("n_tokens"), F.get(c, 4).try_cast("int").alias("n_words"))
