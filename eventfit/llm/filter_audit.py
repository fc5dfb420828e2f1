"""Audit of how text filters interact, by contractions of contingency tensors.

Every document fails or passes each of five filters. Per part the documents
are counted in a tensor of 2x2x2x2x2 cells, one axis a filter. For every order
of the filters and every step, a vector per axis selects those that pass, those
that fail, or all, and one contraction gives the number asked for.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, b"#$%&*|"
#: Bytes of a text whose words are split at once.
WINDOW_BYTES = 1 << 20
_SIGN = re.compile(b"[" + re.escape(SIGNS) + b"]")
MEASURES = ("n", "good", "toxic")
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def word_counts(data: bytes, window: int = WINDOW_BYTES) -> tuple[int, int]:
    """Words and distinct words of a text in UTF-8; ``bytes.split`` parts at exactly the six ASCII white space characters."""
    if len(data) <= window:
        words = data.split()
        return len(words), len(set(words))
    n, seen, rest = 0, set(), b""
    for at in range(0, len(data), window):
        piece = rest + data[at:at + window]
        words = piece.split()
        rest = words.pop() if words and not piece[-1:].isspace() else b""
        n += len(words)
        seen.update(words)
    if rest:
        n += 1
        seen.add(rest)
    return n, len(seen)


def failed_text_filters(data: bytes) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    n, distinct = word_counts(data)
    raw = np.frombuffer(data, np.uint8)
    capitals, points = int(((raw >= 65) & (raw <= 90)).sum()), int(((raw & 0xC0) != 0x80).sum())
    return ((n < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2
            | (_SIGN.search(data) is not None) << 3)


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("failed", pa.int32())])
    for rows in slices(batches):
        texts = [t or b"" for t in rows.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            rows.column("doc_id"), rows.column("part"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            pa.array([failed_text_filters(t) for t in texts], pa.int32())], schema=schema)


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, failed``: the filters that each row of ``docs(doc_id, text, lang)`` fails, as bits 0 to 4."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    rows = settle(own.mapInArrow(_flags, "doc_id long, part string, digest binary, failed int"), "failed_filters")
    # a text's first id passes E. Joined by digest and id, so a text with many copies is no hot key
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("is_first", F.lit(True))
    repeat = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return rows.join(settle(first, "first_ids"), ["digest", "doc_id"], "left") \
        .select("doc_id", "part", (F.col("failed") + F.when(repeat, 16).otherwise(0)).alias("failed"))


def contingency(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, cells``: an array of ``(failed, n, good, toxic)`` per part, at most 32 entries long."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    cells = failures(docs).join(marks, "doc_id", "left").groupBy("part", "failed").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("failed", *MEASURES)).alias("cells"))


def selectors() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Orders and steps, and per number asked for the vectors (one of 2 entries per axis) that select its cells."""
    passes, fails, everything = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
    steps, chosen = [], {k: [] for k in ("kept", "removed", "failing", "unique")}
    for order in itertools.permutations(range(len(FILTERS))):
        for step, own in enumerate(order, 1):
            before = set(order[:step - 1])
            steps.append(("".join(FILTERS[i] for i in order), step))
            for name, here, others in (("kept", passes, lambda i, b=before: i in b), ("removed", fails, lambda i, b=before: i in b),
                                       ("failing", fails, lambda i: False), ("unique", fails, lambda i: True)):
                chosen[name].append([here if i == own else passes if others(i) else everything for i in range(len(FILTERS))])
    return steps, {k: np.array(v, np.int64) for k, v in chosen.items()}


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The sums of ``tensor`` (2x2x2x2x2) over the cells that each row of ``chosen`` selects."""
    return np.einsum("abcde,sa,sb,sc,sd,se->s", tensor, *chosen.transpose(1, 0, 2), optimize="greedy")


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps, chosen = selectors()
    own = np.array([FILTERS.index(order[step - 1]) for order, step in steps])
    for rows in batches:
        for part, cells in zip(rows.column("part").to_pylist(), rows.column("cells").to_pylist(), strict=True):
            tensors = {}
            for m in MEASURES:
                flat = np.zeros(32, np.int64)
                np.add.at(flat, [c["failed"] for c in cells], [c[m] for c in cells])
                tensors[m] = flat.reshape((2,) * 5).transpose()  # bit 0, filter A, as the first axis
            removed = contract(tensors["n"], chosen["removed"])
            total = np.zeros(len(FILTERS), np.int64)
            np.add.at(total, own, removed)
            numbers = [contract(tensors["n"], chosen["kept"]), removed, contract(tensors["n"], chosen["failing"]) - removed,
                       contract(tensors["n"], chosen["unique"]), contract(tensors["good"], chosen["removed"]),
                       contract(tensors["toxic"], chosen["removed"]), total[own]]
            names = RESULT.replace(" string", "").replace(" int", "").replace(" long", "").split(", ")
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * len(steps), pa.string()), pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.int32()),
                *(pa.array(x, pa.int64()) for x in numbers)], names=names)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what is kept and removed, and what each filter adds.

    Null texts count as empty, null languages as the part ''. Rows without an
    id are copies of nothing and have no labels; of equal texts all rows with
    the smallest id pass E. Repeated rows each count; several labels of one id
    count as 1 if any is 1, null ones as 0. Words of very long texts are split
    in windows. Other columns are ignored, also of clashing names; an empty
    table gives an empty result.
    """
    return contingency(docs, labels).mapInArrow(_audit, RESULT)
