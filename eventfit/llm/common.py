"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Documents handled at once inside a Python task; bounds its memory.
SLICE_ROWS = 512
#: Characters handled at once (a single longer text forms its own slice).
SLICE_CHARS = 4_000_000


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage without tying data to one executor: a lost executor
    only means that tasks read the written files again.
    """
    path = scratch_path(df.sparkSession, f"llm/{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_train(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """Rows of ``docs`` that may be learnt from: ``doc_id, text, y``.

    ``max_rows`` bounds the expected size of the training set (a documented
    parameter of the classifiers); beyond it a hash of the id picks the rows.
    Rows without a label, an id or a 0/1 value are left out. Several labels
    of one id count as 1 if any of them is 1.
    """
    y = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
         .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & is_train(F.col("doc_id")))
         .groupBy("doc_id").agg(F.max("y").alias("y")))
    y = settle(y, f"labels_{label}")
    n = y.count()
    if n > max_rows:
        y = y.where(F.pmod(F.xxhash64(F.lit("label sample"), "doc_id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    # at most about max_rows ids and labels: bounded, so the texts stay where they are
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``SLICE_ROWS`` rows and ``most`` characters (or one longer text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, chars = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and (i - start >= SLICE_ROWS or chars + n > most):
                yield batch.slice(start, i - start)
                start, chars = i, 0
            chars += n
        yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public-domain splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def blocked(rows: DataFrame, keys: list[str], number: str, block_rows: int, weight: str | None = None, block_weight: int = 1) -> DataFrame:
    """Deal ``rows`` into blocks of bounded size in which all rows of equal ``keys`` meet.

    ``number``: an id that tells the rows of a key apart. A key with more than
    ``block_rows`` rows is cut into parts by a hash of it, as is one whose
    ``weight`` (a column) sums up to more than ``block_weight``; the parts meet
    two by two in the blocks (``bi``, ``bj``), and ``sub`` is a row's own part.
    Keys of a single row are left out. Blocks come sorted, one after the other.
    """
    heavy = F.sum(weight) if weight else F.lit(0)
    full = settle(rows.groupBy(*keys).agg(F.count("*").alias("key_rows"), heavy.alias("key_weight")).where("key_rows > 1"), "full_keys")
    met = rows.join(full, keys)
    parts = F.ceil(F.greatest(F.col("key_rows") / block_rows, F.least(F.col("key_weight") / block_weight, F.col("key_rows")))).cast("int")
    met = met.withColumn("sub", F.pmod(F.xxhash64(number, *keys), parts).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))) \
        .withColumns({"bi": F.least("sub", "other"), "bj": F.greatest("sub", "other")}).drop("other", "key_rows", "key_weight")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, "bi", "bj"]
    return met.repartition(n, *by).sortWithinPartitions(*by)


def blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The blocks of ``blocked`` rows with at least two rows, in a task."""
    by = [*keys, "bi", "bj"]
    rest: pa.Table | None = None

    def cut(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = rows.combine_chunks().to_batches()[0]
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in by], axis=1)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        for s, e in zip(starts.tolist(), np.r_[starts[1:], len(key)].tolist(), strict=True):
            if e - s > 1:
                yield batch.slice(s, e - s)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        last = np.ones(len(rows), bool)  # rows of a block that may go on in the next batch
        for c in by:
            v = rows.column(c).to_numpy()
            last &= v == v[-1]
        end = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if end:
            yield from cut(rows.slice(0, end))
        rest = rows.slice(end)
    if rest is not None and len(rest):
        yield from cut(rest)


def block_pairs(near: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs marked in ``near[left, right]``, each once."""
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    return left[i], right[j]
