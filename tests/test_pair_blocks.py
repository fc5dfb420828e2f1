"""Pairs counted in blocks inside the tasks: exact counts, and distinct pairs in the shuffle."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventfit.operators import pairs as pr


def brute(rows_, window, chunk):
    """Pairs as the arrays of the chunks give them, also where documents share an id."""
    parts = {}
    for doc, pos, k in rows_:
        parts.setdefault((doc, pos // chunk), []).append((pos, k))
        if pos % chunk < window and pos >= chunk:
            parts.setdefault((doc, pos // chunk - 1), []).append((pos, k))
    n = Counter()
    for (_, part), z in parts.items():
        z.sort()
        for i, (p, k) in enumerate(z):
            if p // chunk == part:
                n.update((k, j) for q, j in z[i + 1:i + 1 + window] if q - p <= window)
    return n


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_blocks_count_every_pair_once(monkeypatch, block):
    monkeypatch.setattr(pr, "BLOCK_TOKENS", block)
    monkeypatch.setattr(pr, "BLOCK_PAIRS", 50)
    monkeypatch.setattr(pr, "HELD_PAIRS", 60)
    r, chunk, window = random.Random(3), 16, 5
    toks = [(d, p, r.randrange(9)) for d in (None, 1, 2, 2, 5) for p in range(r.choice([1, 40, 90])) if r.random() < 0.8]
    rows_ = sorted(((d, c, p, k) for d, p, k in toks for c in {p // chunk, *([p // chunk - 1] if p % chunk < window and p >= chunk else [])}),
                   key=lambda x: (-1 if x[0] is None else x[0], *x[1:]))
    table = pa.table([pa.array(x) for x in zip(*rows_, strict=True)], names=["doc_id", "chunk", "pos", "k"])
    got = Counter()
    for b in pr.pair_counter(window, chunk, 7)(iter(table.to_batches(max_chunksize=4))):
        for part, data in zip(b["part"].to_pylist(), b["data"].to_pylist(), strict=True):
            keys, n = pr.unpack(data)
            assert set(pr.part_of(keys, 7).tolist()) == {part}
            for key, c in zip(keys.tolist(), n.tolist(), strict=True):
                got[key >> 32, key & 0xFFFFFFFF] += c
    assert got == brute(toks, window, chunk)


def test_distinct_pairs_are_shuffled_not_occurrences(spark):
    """A pair that occurs thousands of times leaves a task once."""
    toks = spark.range(20000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), F.lit("w").alias("tok"))
    t = pr.chunk_rows(toks, pr.word_ids(toks.select(F.col("tok").alias("word"))), 10, 1024).select("doc_id", "chunk", "pos", "k").coalesce(1)
    sent = t.sortWithinPartitions("doc_id", "chunk", "pos", "k").mapInArrow(pr.pair_counter(10, 1024, 3), "part int, data binary")
    assert [pr.unpack(r.data)[1].tolist() for r in sent.collect()] == [[sum(20000 - d for d in range(1, 11))]]
    assert rows(pr.window_pair_counts(toks, None, 10, 1)) == [("w", "w", float(sum(20000 - d for d in range(1, 11))))]


def test_merged_counts():
    k, n = pr.merged_counts(np.array([3, 1, 3, 2]), np.array([1, 2, 4, 8]))
    assert k.tolist() == [1, 2, 3] and n.tolist() == [2, 8, 5]
    assert [x.tolist() for x in pr.merged_counts(np.empty(0, np.int64), np.empty(0, np.int64))] == [[], []]


def test_pack_and_unpack():
    keys, n = np.array([0, 5, 1 << 20, (7 << 32) | 9, (1 << 62) + 3]), np.array([1, 2, 300, 1 << 33, 5])
    assert [x.tolist() for x in pr.unpack(pr.pack(keys, n))] == [keys.tolist(), n.tolist()]
    assert [x.tolist() for x in pr.unpack(pr.pack(keys[:0], n[:0]))] == [[], []]
