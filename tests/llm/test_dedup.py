"""Near-duplicates of texts and vectors against brute force."""

import random

import numpy as np
import pytest

from eventfit.llm import graph, near_embeddings, superminhash


def components_of(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def fixture_docs():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([6, 30, 120, 400]))] for _ in range(25)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 1, 4])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 3, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append("\t".join(copy).upper())
    chain = [rng.choice(vocab) for _ in range(100)]  # each links with the next, the ends do not
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = chain[4:] + [rng.choice(vocab) for _ in range(4)]
    texts += ["", "   \n ", None, "one two", "One  Two", "one two three", "a a a a a a a a", "a a a a a", "Ärger ärger x y z", "x" * 50_000, "lone " * 9000]
    texts += [texts[0]] * 40
    return list(enumerate(texts))


def brute_links(rows):
    sets = {i: superminhash.shingles_of(superminhash.words_of(t)) if t else set() for i, t in rows}
    links = [(a, b) for a, _ in rows for b, _ in rows if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, links


def test_minhash_equals_brute_force(spark):
    rows = fixture_docs()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, n_shingles int")
    got = {r.doc_id: r for r in superminhash.near_duplicates(docs).collect()}
    sets, links = brute_links(rows)
    want = components_of([i for i, _ in rows], links)
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i)


def test_minhash_odd_rows(spark):
    text = "the same five words are here again and again"
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (2, text), (7, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in superminhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 5, None, True), (4, 5, 2, False), (4, 5, 2, False), (2, 5, 2, True), (7, 0, 7, True)], key=str)
    assert superminhash.near_duplicates(docs.where("doc_id > 100")).count() == 0


def test_superminhash_signature_is_a_minimum_over_ranks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 40, 900)] + [np.zeros(0, np.uint64)]
    sig = superminhash.superminhash(sets)
    assert np.isinf(sig[-1]).all() and np.isfinite(sig[:-1]).all()
    # one element alone fills every slot with each rank once
    assert sorted(np.floor(sig[0]).astype(int)) == list(range(superminhash.SLOTS))
    # a union's signature is the slotwise minimum of the parts' full signatures
    whole = superminhash.superminhash([np.unique(np.concatenate(sets[:3]))])[0]
    parts = np.minimum.reduce([superminhash.superminhash([np.array([x])])[0] for s in sets[:3] for x in s])
    assert (whole == parts).all()


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(200):
        pool = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        a, b = pool[:250], pool[50:]
        s = superminhash.superminhash([a, b])
        errors.append((s[0] == s[1]).mean() - 200 / len(pool))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (3, 2), (300, 301), (301, 300)]
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_of({x for e in edges for x in e}, edges)
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fixture_vectors():
    rng = np.random.default_rng(3)
    out = []
    for group in range(60):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(1, 7)):
            noise = rng.normal(size=64)
            out.append((centre + noise / np.linalg.norm(noise) * rng.choice([0.05, 0.15, 0.25, 0.5])) * rng.choice([0.1, 1.0, 30.0]))
    centre = rng.normal(size=64)
    out += [centre + 0.01 * rng.normal(size=64) for _ in range(700)]  # a cell of more than one block
    out += [out[0]] * 5
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 64), (n + 2, [float("nan")] * 64), (n + 3, [1.0] * 63 + [float("inf")]), (n + 4, [None] + [1.0] * 63), (n + 5, []),
             (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0])]
    return rows


def test_embeddings_equal_brute_force(spark):
    rows = fixture_vectors()
    vectors = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<float>, cid string")
    got = {r.vec_id: r for r in near_embeddings.near_duplicates(vectors).collect()}
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = set()
    for size in (64, 2):
        ids = [i for i in good if len(good[i]) == size]
        x = np.array([good[i] for i in ids])
        c = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
        links |= {(ids[a], ids[b]) for a, b in np.argwhere(c >= 0.95) if a != b}
    found = sum(r.n_links for r in got.values())
    assert found <= len(links) and found >= 0.99 * len(links)
    want = components_of([i for i, _ in rows], links)
    assert len(got) == len(rows)
    same = [got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i, _ in rows]
    assert np.mean(same) > 0.99
    for i in set(dict(rows)) - set(good):
        assert tuple(got[i]) == (i, 0, i, True)


def test_embedding_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(400, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    code, factor = near_embeddings.encode(x)
    err = near_embeddings.estimate(code, factor, y).diagonal() - 0.95
    assert abs(err.mean()) < 0.01
    assert (np.abs(err) <= near_embeddings.slack(factor, 64, 0.95)).all()


def test_embeddings_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_embeddings.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in near_embeddings.near_duplicates(twice).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]


@pytest.mark.parametrize("rows,least", [(100, 1), (50_000, 2), (10**9, 3)])
def test_cells_grow_with_the_table(rows, least):
    k, tables = near_embeddings.tables_for(rows)
    assert k >= least and (1 - near_embeddings.SAME_CELL**k) ** tables <= near_embeddings.MISS


def test_variance_factor():
    factor = superminhash.variance_factor()
    assert (factor > 0).all() and (factor <= 1).all() and (np.diff(factor[2:]) > -1e-9).all() and factor[-1] > 0.95


def sharers(n, shared=240, own=60):
    passage = " ".join(f"p{i}" for i in range(shared + 4))
    return [(i, f"{passage} {' '.join(f'd{i}w{k}' for k in range(own))}") for i in range(n)]


@pytest.mark.parametrize("n", [300, 900])
def test_passage_sharers_below_the_threshold_send_no_pairs(spark, monkeypatch, n):
    """All pairs are at two thirds; the signatures let most of them pass, the blocks none."""
    sent = []
    across = superminhash._across

    def spy(*args):
        df = superminhash.settle(across(*args), "spy")
        sent.append(df.count())
        return df

    monkeypatch.setattr(superminhash, "_across", spy)
    docs = spark.createDataFrame([*sharers(n), (n, sharers(1)[0][1] + " more")], "doc_id long, text string")
    got = {r.doc_id: r for r in superminhash.near_duplicates(docs).collect()}
    assert {i for i, r in got.items() if not r.kept} == {n} and got[n].component_id == 0
    assert sent[0] <= 20


def test_blocks_are_bounded_by_weight(spark):
    from eventfit.llm import common
    rows = spark.range(60).selectExpr("1L as k", "id", "if(id = 0, 1000L, 10L) as n")
    got = common.blocked(rows, ["k"], "id", 512, "n", 400).collect()
    met = {(r.bi, r.bj): [] for r in got}
    for r in got:
        met[r.bi, r.bj].append(r.id)
    pairs = {(a, b) for ids in met.values() for a in ids for b in ids}
    assert len(pairs) == 60 * 60 and len(met) > 3
    assert len(common.blocked(rows, ["k"], "id", 512).select("bi", "bj").distinct().collect()) == 1


def test_worker_functions_need_no_package(tmp_path):
    """A task unpickles them where the package is not installed."""
    import subprocess
    import sys
    from types import SimpleNamespace

    from pyspark import cloudpickle

    from eventfit.llm import byte_bpe, filter_audit, nbest, packing, token_alignment, token_count, toxicity
    box = SimpleNamespace(value=None)
    functions = [superminhash._sign, superminhash._alike(0.75), superminhash._alike_in_block(0.75), superminhash._confirm(0.75), superminhash._shingle_lists,
                 near_embeddings._coder(2, 2, None), near_embeddings._comparer(0.95), byte_bpe._encode(box), byte_bpe._decode(box, "ids"),
                 token_alignment._aligner(box, box), token_alignment._scorer, filter_audit._flags, filter_audit._audit, nbest._segmenter(box, 3),
                 nbest._decoder(box, "best"), token_count._counter(box), toxicity._letters_counter, toxicity._term_counter, toxicity._restored(box), toxicity._evidence(box, box, "text"),
                 packing._encoder(box, 2048)]
    (tmp_path / "functions.pickle").write_bytes(cloudpickle.dumps(functions))
    code = "import pickle; print(len(pickle.load(open('functions.pickle', 'rb'))))"
    out = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == str(len(functions)), out.stderr


def test_signing_holds_little_at_once():
    """Shuffles of a million characters' shingles took a worker's largest share of memory."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 300).tolist()) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64())] * 2 + [pa.array(texts)], names=["doc_id", "text_hash", "text"])
    tracemalloc.start()
    try:
        signed = pa.Table.from_batches(list(superminhash._sign(iter([batch]))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert signed.column("doc_id").to_pylist() == list(range(500)) and signed.column("n_shingles").to_pylist() == [296] * 500
    assert peak < 20_000_000, peak
