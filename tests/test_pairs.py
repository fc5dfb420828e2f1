"""Two-pass pair counts: the sketch never loses a frequent pair, and most rare ones are not shuffled."""

import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventfit.operators import pairs as pr


@pytest.fixture(scope="module")
def toks(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    out = []
    for d in range(40):
        # one word holds a third of all tokens
        out += [(d, i, "hot" if r.random() < 0.33 else r.choice(words)) for i in range(r.choice([0, 1, 30, 150, 400]))]
    return pr._written(spark.createDataFrame(out, "doc_id long, pos int, tok string").repartition(3), "test_toks")


def brute(toks, window, min_freq):
    docs = {}
    for t in toks.collect():
        docs.setdefault(t.doc_id, {})[t.pos] = t.tok
    n = Counter((d[i], d[j]) for d in docs.values() for i in d for j in range(i + 1, i + window + 1) if j in d)
    return sorted((a, b, float(c)) for (a, b), c in n.items() if c >= min_freq)


@pytest.mark.parametrize("most", [1 << 16, 1 << 27])
@pytest.mark.parametrize("min_freq", [1, 2, 5])
def test_counts_equal_brute_force(spark, toks, monkeypatch, most, min_freq):
    monkeypatch.setattr(pr, "MOST_BUCKETS", most)
    for sketch in (False, True):
        assert rows(pr.window_pair_counts(toks, None, 6, min_freq, chunk=64, sketch=sketch)) == brute(toks, 6, min_freq)


@pytest.mark.parametrize("buckets", [64 * 1024, 128 * 1024])
def test_sketch_keeps_every_frequent_pair_and_drops_most_others(spark, toks, buckets):
    ids = pr.word_ids(toks.select(F.col("tok").alias("word")))
    keys = pr.pair_keys(pr._written(pr.chunk_arrays(toks, ids, 6, 64), "test_chunks"), 6, 64)
    bitmap = pr.frequent_buckets(keys, buckets, 5)
    assert bitmap.agg(F.sum(F.size("bits"))).first()[0] * 64 == buckets
    kept = Counter(r.key for r in pr.surviving(keys, bitmap, buckets).collect())
    every = Counter(r.key for r in keys.collect())
    assert all(kept[k] == n for k, n in every.items() if n >= 5)
    assert len(kept) < len(every) / 4  # what is shuffled: distinct pairs


def test_overfull_buckets_still_give_exact_counts(spark, toks, monkeypatch):
    monkeypatch.setattr(pr, "LEAST_BUCKETS", 1 << 16)
    monkeypatch.setattr(pr, "MOST_BUCKETS", 1 << 16)
    monkeypatch.setattr(pr, "bucket_of", lambda key, buckets: F.xxhash64(key).bitwiseAND(F.lit(255)))
    assert rows(pr.window_pair_counts(toks, None, 6, 5, chunk=64, sketch=True)) == brute(toks, 6, 5)


def test_tokens_are_scanned_once(spark, toks):
    ids = pr.word_ids(toks.select(F.col("tok").alias("word")))
    plan = pr.chunk_arrays(toks, ids, 6, 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("tok#") and sum("FileScan" in x and "pos#" in x for x in plan.splitlines()) == 1


def test_empty(spark, toks):
    assert pr.window_pair_counts(toks.limit(0), None, 6, 5).collect() == []
