"""Report sinks (K1, K2, K8, K9), the ordered writer of K3-K7, and the text writers used by the source
round trips.

All writes go below the shared checkpoint folder; score tables are written
partitioned by their metadata columns so that one folder per dataset x model
x metric x normalisation comes out, like the reference's file naming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _str(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def tsv_line(*cols: Column) -> Column:
    """Tab-joined fields; NULL prints as ``None`` like the reference."""
    return F.concat_ws("\t", *[_str(c) for c in cols])


def write_lines(df: DataFrame, line: Column, path: str, compression: str | None = None,
                line_sep: str | None = None, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    cols = [line.alias("value")] + [F.col(c) for c in (partition_by or [])]
    w = df.select(*cols).write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if line_sep:
        w = w.option("lineSep", line_sep)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)
    return path


def write_ordered(df: DataFrame, line: Column, keys: list[str], path: str) -> str:
    """A report whose lines are in the order of ``keys`` over all part files:
    rows are range-partitioned and sorted, and part numbers follow the ranges."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def write_sentence_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K1: ``id, text, score, n_tokens, n_words`` per dataset x model x
    metric x norm folder."""
    line = tsv_line(F.col("id"), F.col("text"), F.col("score"), F.col("n_tokens"), F.col("n_words"))
    return write_lines(scores, line, path, partition_by=["dataset", "model", "metric", "norm"], mode=mode)


def write_word_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K2: ``id, text, score``."""
    line = tsv_line(F.col("id"), F.col("text"), F.col("score"))
    return write_lines(scores, line, path, partition_by=["dataset", "model", "metric", "norm"], mode=mode)


def write_surprisal_report(report: DataFrame, path: str) -> str:
    """K8: ``idx, text, surprisal, sentence, unk`` without header."""
    line = tsv_line(F.col("idx"), F.col("text"), F.col("surprisal"), F.col("sentence"), F.col("unk"))
    return write_lines(report, line, path)


def write_sentences(sent: DataFrame, path: str) -> str:
    """K9: one prepared sentence per line (the scorer's input file)."""
    return write_lines(sent, F.col("text"), path)
