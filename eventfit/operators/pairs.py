"""Windowed pair counts with a minimum frequency.

Tokens are read once: those of the vocabulary get integer ids and go, with
their positions, to bounded chunks of their document; a token near a chunk's
beginning also goes to the chunk before. Pairs are made inside the chunks as
one integer each. A task makes and counts them as arrays, some millions at a
time, and hands on distinct pairs with their counts, so that the shuffle does
not carry every occurrence.

Where most pairs are rare, a first pass can count them in a sketch, one row of
a count-min sketch whose partial counts of all tasks add up: a bucket's count
is an upper bound for each of its pairs. The second pass then counts exactly,
and only pairs whose bucket reaches the minimum are shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .ranking import dense_index

#: The sketch has at least and at most so many buckets (powers of two); the most bounds the broadcast
#: bit map at 16 MB. A row of the map holds this many 64-bit words.
LEAST_BUCKETS, MOST_BUCKETS, ROW_WORDS = 1 << 16, 1 << 27, 1024

#: What a task holds while it counts pairs: tokens read at once, pairs not yet sorted, distinct pairs. About 250 MB.
BLOCK_TOKENS, BLOCK_PAIRS, HELD_PAIRS = 1 << 18, 1 << 22, 4 << 20
#: Occurrences whose distinct pairs one task adds up, at most 16 bytes each.
TASK_PAIRS = 1 << 24

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"pairs/{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_ids(words: DataFrame) -> DataFrame:
    """``(word, k)``: the distinct words numbered from 0, written so that frequent words can be split in joins."""
    return _written(dense_index(words.select("word"), "word"), "word_ids")


def chunk_rows(toks: DataFrame, ids: DataFrame, window: int, chunk: int) -> DataFrame:
    """``(doc_id, chunk, pos, k)``: the tokens of the vocabulary dealt by chunk, a chunk in one task.

    One scan of ``toks(doc_id, pos, tok)`` and one shuffle of about
    ``n * (1 + window / chunk)`` rows of integers.
    """
    c = F.floor(F.col("pos") / chunk)
    near = ((F.col("pos") % chunk) < window) & (F.col("pos") >= chunk)
    t = toks.select("doc_id", "pos", F.col("tok").alias("word")).join(ids, "word")
    t = t.select("doc_id", "pos", "k", F.explode(F.when(near, F.array(c, c - 1)).otherwise(F.array(c))).alias("chunk"))
    # a number of its own: the pairs are made behind this shuffle, which its small size does not show
    return t.repartition(int(toks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "chunk")


def chunk_arrays(toks: DataFrame, ids: DataFrame, window: int, chunk: int) -> DataFrame:
    """``(chunk, z)``: the tokens of each chunk as ``array<struct<pos, k>>`` in order, at most ``chunk + window`` of them."""
    t = chunk_rows(toks, ids, window, chunk)
    return t.groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "k"))).alias("z")).drop("doc_id")


def block_pairs(doc: np.ndarray, part: np.ndarray, pos: np.ndarray, k: np.ndarray, new: int, window: int, chunk: int) -> np.ndarray:
    """Keys of the pairs whose right token is at index ``new`` or later, in rows ordered by document, chunk, position and word."""
    own, out = pos // chunk == part, []
    for d in range(1, min(window, len(k) - 1) + 1):
        lo = max(new - d, 0)
        a, b = slice(lo, len(k) - d), slice(lo + d, len(k))
        at = np.flatnonzero(own[a] & (part[a] == part[b]) & (doc[a] == doc[b]) & (pos[b] - pos[a] <= window))
        out.append((k[a][at] << 32) | k[b][at])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def merged_counts(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys as differences, and their counts, byte by byte: the high bytes are nearly all zero and compress away."""
    planes = (np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T for x in (np.diff(keys, prepend=0), n))
    return np.concatenate([*planes]).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``pack`` has packed."""
    planes = np.frombuffer(data, np.uint8).reshape(16, -1)
    steps, n = (np.ascontiguousarray(x.T).view("<i8").ravel().astype(np.int64) for x in (planes[:8], planes[8:]))
    return np.cumsum(steps), n


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The task that adds up a key. Neighbouring keys, at most 4,096, stay together, so that their differences are small."""
    mixed = (keys >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return (mixed % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)


def pair_counter(window: int, chunk: int, parts: int):
    """The function for ``mapInArrow``: sorted rows of ``chunk_rows`` to ``(part, data)``, the packed pairs of a block by part."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_TOKENS:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = part_of(keys, parts)
        order = np.argsort(part, kind="stable")
        keys, n, part = keys[order], n[order], part[order]
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
        ends = np.append(at[1:], len(part))
        for i in range(0, len(at), 64):
            some = [*zip(at[i:i + 64], ends[i:i + 64], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[at[i:i + 64]].astype(np.int32)),
                                              pa.array([pack(keys[x:y], n[x:y]) for x, y in some], pa.binary())], names=["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, loose, counted = None, [], []
        for table in blocks(batches):
            t = table if before is None else pa.concat_tables([before, table])
            doc = t["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            part, pos, k = (t[c].to_numpy().astype(np.int64) for c in ("chunk", "pos", "k"))
            loose.append(block_pairs(doc, part, pos, k, t.num_rows - table.num_rows, window, chunk))
            before = t.slice(max(t.num_rows - window, 0)).combine_chunks()
            if sum(map(len, loose)) >= BLOCK_PAIRS:
                counted.append(np.unique(np.concatenate(loose), return_counts=True))
                loose = []
                if sum(len(x) for x, _ in counted) >= HELD_PAIRS:
                    counted = [merged_counts(*map(np.concatenate, zip(*counted, strict=True)))]
                    if len(counted[0][0]) >= HELD_PAIRS // 2:
                        yield from rows(*counted.pop())
        if loose:
            counted.append(np.unique(np.concatenate(loose), return_counts=True))
        if counted:
            yield from rows(*merged_counts(*map(np.concatenate, zip(*counted, strict=True))))

    return run


def pair_adder(min_freq: int):
    """The function for ``mapInArrow``: rows ``(part, data)``, all of a part in one task, to ``(key, freq)`` from the minimum on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        loose: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for data in (x.as_py() for b in batches for x in b["data"]):
            loose.append(unpack(data))
            size += len(loose[-1][0])
            if size >= max(BLOCK_PAIRS, len(keys)):
                keys, n = merged_counts(*map(np.concatenate, zip((keys, n), *loose, strict=True)))
                loose, size = [], 0
        keys, n = merged_counts(*map(np.concatenate, zip((keys, n), *loose, strict=True)))
        at = n >= min_freq
        keys, n = keys[at], n[at].astype(np.float64)
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + (1 << 16)]), pa.array(n[i:i + (1 << 16)])], names=["key", "freq"])

    return run


def counted_pairs(toks: DataFrame, ids: DataFrame, window: int, chunk: int, min_freq: int) -> DataFrame:
    """``(key, freq)``: the exact counts from ``min_freq`` on. The counts of a
    block meet in as many tasks as ``TASK_PAIRS`` asks for; a frequent pair comes
    once a block, so no task gets more than its share."""
    t = chunk_rows(toks, ids, window, chunk).select("doc_id", "chunk", "pos", "k").sortWithinPartitions("doc_id", "chunk", "pos", "k")
    parts = max(int(toks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-toks.count() * window // TASK_PAIRS))
    blocks = t.mapInArrow(pair_counter(window, chunk, parts), "part int, data binary")
    return blocks.repartitionById(parts, "part").mapInArrow(pair_adder(min_freq), "key long, freq double")


def pair_keys(chunks: DataFrame, window: int, chunk: int) -> DataFrame:
    """``(key)``: left id << 32 | right id of every pair whose left token lies in the chunk itself."""
    def partners(x: Column, i: Column) -> Column:
        after = F.filter(F.slice("z", i + 2, window), lambda y: y["pos"] - x["pos"] <= window)
        return F.transform(after, lambda y: F.shiftleft(x["k"], 32).bitwiseOR(y["k"]))

    own = F.transform("z", lambda x, i: F.when(F.floor(x["pos"] / chunk) == F.col("chunk"), partners(x, i)).otherwise(F.array().cast("array<bigint>")))
    return chunks.select(F.explode(F.flatten(own)).alias("key"))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(buckets - 1))


def buckets_for(pairs: int) -> int:
    """A power of two at least twice the number of pairs, within the limits."""
    return min(max(1 << (2 * pairs - 1).bit_length(), LEAST_BUCKETS), MOST_BUCKETS)


def frequent_buckets(keys: DataFrame, buckets: int, min_freq: int) -> DataFrame:
    """``(row, bits)``: a bit map of the buckets that hold at least ``min_freq`` pairs, at most ``MOST_BUCKETS`` / 8 bytes."""
    full = keys.groupBy(bucket_of(F.col("key"), buckets).alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_freq)
    words = full.groupBy(F.shiftright("b", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    every = keys.sparkSession.range(buckets // 64).join(words, "id", "left")
    return every.groupBy(F.floor(F.col("id") / ROW_WORDS).alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))["bits"].alias("bits"))


def surviving(keys: DataFrame, bitmap: DataFrame, buckets: int) -> DataFrame:
    """The pairs whose bucket is set in the bit map."""
    k = keys.withColumn("b", bucket_of(F.col("key"), buckets))
    word = F.get("bits", F.shiftright("b", 6).bitwiseAND(F.lit(ROW_WORDS - 1)).cast("int"))
    bit = F.getbit(word, F.col("b").bitwiseAND(F.lit(63)).cast("int"))
    return k.join(F.broadcast(bitmap), F.shiftright("b", 6 + ROW_WORDS.bit_length() - 1) == F.col("row")).where(bit == 1).select("key")


def window_pair_counts(toks: DataFrame, vocab: DataFrame | None = None, window: int = 10,
                       min_freq: int = 1, chunk: int = 1024, sketch: bool = False) -> DataFrame:
    """Ordered pairs ``(w1, w2)`` with ``w2`` at most ``window`` tokens
    after ``w1`` in the same document, counted from ``min_freq`` on.

    Tokens outside ``vocab`` (all words if it is None) are dropped *before* the
    pairs are made, keeping their positions. With ``sketch`` rare pairs are not
    shuffled as pairs; it pays where they are most of all occurrences. A sketch
    is only made where it can tell pairs apart, that is, where ``min_freq`` is
    over 1 and its buckets are not all full on average. The counts are the
    same without it.
    """
    chunk = max(chunk, window)  # a partner must lie in the same or the next chunk
    words = toks.select(F.col("tok").alias("word")) if vocab is None else vocab
    ids = word_ids(words)
    out = None
    if sketch and min_freq > 1:
        chunks = _written(chunk_arrays(toks, ids, window, chunk), "chunks")
        keys = pair_keys(chunks, window, chunk)
        pairs = window * (chunks.agg(F.sum(F.size("z"))).first()[0] or 0)
        buckets = buckets_for(pairs)
        if pairs < buckets * min_freq:
            kept = surviving(keys, _written(frequent_buckets(keys, buckets, min_freq), "buckets"), buckets)
            out = kept.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("freq"))
    out = counted_pairs(toks, ids, window, chunk, min_freq) if out is None else out.where(F.col("freq") >= min_freq)
    named = lambda name, k: ids.select(F.col("word").alias(name), F.col("k").alias(k))
    out = out.select("freq", F.shiftright("key", 32).alias("k1"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("k2"))
    return out.join(named("w1", "k1"), "k1").join(named("w2", "k2"), "k2").select("w1", "w2", "freq")
