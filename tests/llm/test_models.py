"""Classifiers: restoring, features, fits and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventfit.llm import quality_model, toxicity
from eventfit.llm.common import is_train

SF = "/root/testdata/sf0.01"


def restorer(words):
    import pyarrow as pa
    batch = next(toxicity._letters_counter(iter([pa.RecordBatch.from_pydict({"text": [" ".join(words)]})])))
    counts = np.zeros(toxicity.LETTERS**3)
    counts[batch.column("code").to_numpy()] = batch.column("n").to_numpy()
    tri = counts.reshape((toxicity.LETTERS,) * 3) + 0.01
    return toxicity.Restorer(-np.log(tri / tri.sum(axis=2, keepdims=True)))


def test_restoring():
    r = restorer(["idiot", "moron", "stupid", "trash", "the", "of", "committee", "pathetic"] * 50)
    for seen, want in [("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d!!", "stupid"), ("iiidiooot", "idiot"), ("tr@sh", "trash"), ("committee", "committee"),
                       ("path3t!c", "pathetic"), ("***", ""), ("2024", ""), ("Éa".lower(), "éa")]:
        assert r.word(seen) == want
    assert "idiot" in toxicity.run_words(r.restore("i d i o t"))
    assert toxicity.split_tokens("said i d i o t then")[1] == ["i d i o t"]


def brute_restore(r, chars):
    def walk(i, a, b, cost, read):
        if i == len(chars):
            yield cost + r.costs[a][b][0], read
            return
        for end, c, price in r.arcs(chars)[i]:
            if not c:
                yield from walk(end, a, b, cost + price, read)
            elif c == " ":
                yield from walk(end, 0, 0, cost + price + r.costs[a][b][0], read + c)
            else:
                x = toxicity.fold(c)
                yield from walk(end, b, x, cost + price + r.costs[a][b][x], read + c)
    return min(walk(0, 0, 0, 0.0, ""))


def test_viterbi_equals_enumeration():
    r = restorer(["idiot", "tilt", "till", "a", "toot"] * 20)
    rng = random.Random(1)
    for _ in range(60):
        chars = "".join(rng.choice("idot10! l") for _ in range(rng.randrange(1, 7))).strip() or "i"
        assert r.restore(chars) == brute_restore(r, chars)[1]


def test_long_runs_are_read_to_their_end():
    r = restorer(["idiot", "moron", "stupid", "trash", "the", "of", "committee", "pathetic"] * 50)
    rng = random.Random(3)
    beginnings = set(toxicity.term_ids("badword")[1:])
    for n in (70, 250, 5000):
        found = {t for w in toxicity.run_words("".join(rng.choice("aeiorstln") for _ in range(n)) + "zzbadword") for t in toxicity.term_ids(w)}
        assert beginnings <= found and toxicity.term_ids("badword")[0] in found
    long = " ".join("thecommitteeof" * 40 + "1d10t" + "thecommitteeof" * 40)
    (run,) = toxicity.split_tokens(long)[1]
    read = toxicity.run_words(r.restore(run))
    assert len(run) > 2000 and any(w.startswith("idiot") for w in read)
    part = toxicity.pa.RecordBatch.from_pydict({"text": [f"so {long} it"]})
    assert any(w.startswith("idiot") for w in next(toxicity._slice_words(part, r, {})))


def test_marked_doubled_and_long_tokens_are_restored():
    r = restorer(["idiot", "moron", "stupid", "trash", "the", "of", "committee", "pathetic"] * 50)
    words = np.zeros(toxicity.TERMS, np.int64)
    for w, n in (("idiot", 50), ("stupid", 50), ("committee", 50), ("comite", 90), ("asshole", 50), ("idiiot", 2)):
        words[toxicity.word_bucket(w)] = n
    r = toxicity.Restorer(np.array(r.costs), words)

    def found(text):
        return next(toxicity._slice_words(toxicity.pa.RecordBatch.from_pydict({"text": [text]}), r, {}))

    for seen in ("s.t.u.p.i.d", "s-t-u-p-i-d", "s_t_u_p_i_d", "stu-pid", "stuupid", "ssttupidd", "st" + "u" * 40 + "pid", "s\u0336tupid", "s.t.u.p.1.d"):
        assert "stupid" in found(f"so {seen}, then"), seen
    assert {"idiiot", "idiot"} <= found("idiiot") and "asshole" in found("aasshoole")
    assert found("committee") == {"committee"}
    joined = "th3c0mm1tt33" * 5 + "1d10t" + "th3c0mm1tt33" * 5
    assert any(w.startswith("idiot") for w in found(joined))
    assert not toxicity.is_marked("हिन्दी") and toxicity.is_marked("well-known")


def test_long_lattices_equal_the_plain_viterbi():
    def plain(r, chars):
        states = [{} for _ in range(len(chars) + 1)]
        states[0][0, 0] = (0.0, "")
        for i, here in enumerate(r.arcs(chars)):
            for (a, b), (cost, read) in states[i].items():
                for end, c, price in here:
                    x = toxicity.fold(c) if c.strip() else 0
                    key = (a, b) if not c else (0, 0) if c == " " else (b, x)
                    new = (cost + price + (r.costs[a][b][x] if c else 0), read + c)
                    states[end][key] = min(new, states[end].get(key, new))
        return min((cost + r.costs[a][b][0], read) for (a, b), (cost, read) in states[-1].items())[1]

    r = restorer(["idiot", "tilt", "till", "a", "toot", "stupid"] * 20)
    rng = random.Random(2)
    for n in (60, 64, 65, 130, 300, 300, 300):
        chars = "".join(rng.choice("idot10!*. ls") * rng.choice((1, 1, 1, 2, 9)) for _ in range(n)).strip()
        assert r.restore(chars) == plain(r, chars)
    assert len(r.restore("u" * 100_000)) < 100 and r.restore("*" * 100_000).isalpha()


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_squeezed_words_hold_the_lattice_reading():
    """A plain word's lattice reads it with some doubled letters squeezed, and nothing else."""
    from itertools import combinations
    r, rng = restorer(["idiot", "moron", "committee", "bookkeeper", "hello"] * 50), random.Random(5)
    for _ in range(300):
        token = "".join(c * rng.choice([1, 1, 2]) for c in rng.choice(["idiot", "moron", "comite", "bokeper", "helo", "été"]))
        places = [m.start() for m in toxicity._DOUBLED.finditer(token)]
        if token.isalpha() and not toxicity._ODD.search(token):
            squeezed = {"".join(c for i, c in enumerate(token) if i not in out) for k in range(len(places) + 1) for out in combinations(places, k)}
            assert r.restore(token) in squeezed


def test_written_words_give_the_same_evidence():
    """Training rows are scored from the words that were written, as if their texts had been restored again."""
    from types import SimpleNamespace
    texts = ["you are an 1d1ot", None, "", "so i d i o t it is", "  \t\n", "a i-d-i-o-t iidiott", "quiet words\x85here\x1cthere \u2028 end"] * 2
    model = SimpleNamespace(value=(np.array(restorer(["idiot", "quiet", "words", "here"] * 50).costs), np.ones(toxicity.TERMS, np.int64)))
    table = SimpleNamespace(value=({t: (3, 4) for t in toxicity.term_ids("idiot")}, 0.02))
    schema = toxicity.pa.schema([("doc_id", toxicity.pa.int64()), ("text", toxicity.pa.string()), ("y", toxicity.pa.int32())])
    rows = toxicity.pa.RecordBatch.from_pylist([{"doc_id": i, "text": t, "y": [1, 0, None][i % 3]} for i, t in enumerate(texts)], schema)
    written = list(toxicity._restored(model)(iter([rows])))
    from_words = [r for b in toxicity._evidence(model, table, "words")(iter(written)) for r in b.to_pylist()]
    from_texts = [r for b in toxicity._evidence(model, table, "text")(iter([rows])) for r in b.to_pylist()]
    assert from_words == from_texts and len(from_texts) == len(texts)
    assert {r["x0"] for r in from_texts} != {from_texts[1]["x0"]}


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeiorstln") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randrange(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                bad = rng.choice(["grobnak", "flumzig"])
                if zlib.crc32(str(i).encode()) % 5 == 0:
                    bad = rng.choice([bad, bad.replace("o", "0").replace("i", "1"), bad.replace("a", "aaa").replace("u", "uuu"), " ".join(bad)])
                words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words), "x", "clash"))
        labels.append((i, int(toxic)))
    rows += [(5000, None, None, None), (5001, "", "x", ""), (None, "grobnak grobnak", "x", ""), (5002, "z" * 100_000, "x", ""), rows[0], rows[0]]
    docs = docs_of(spark, rows)
    got = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    right = np.mean([r.predicted == truth[r.doc_id] for r in held])
    assert right > 0.97, right
    by_id = {r.doc_id: r for r in got}
    assert by_id[5000].predicted == by_id[5001].predicted == 0 and by_id[None].predicted == 1 and not by_id[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = toxicity.score_documents(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == len(rows) and all(r.predicted == 0 for r in none)
    assert toxicity.score_documents(docs.where("doc_id > 99999"), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score_documents(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert got.count() == docs.count()


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = [(i, "Good words in a row here." * (i + 1) if i % 2 else "### $$$ !!! " * (i + 1), "x", "y") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "x", "y"), (None, "text", "x", "y"), (102, "q" * 200_000, "x", "y"), rows[0]]
    docs = docs_of(spark, rows)
    got = quality_model.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60]) > 0.9
    assert quality_model.score_documents(docs.where("doc_id > 999"), labels).count() == 0
    empty = quality_model.score_documents(docs, labels.where("doc_id < 0")).collect()
    assert all(r.score == 0.5 for r in empty)


def test_held_out_rows(spark):
    ids = [*range(300), None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", is_train(F.col("doc_id")).alias("t")).collect()
    for r in got:
        assert r.t == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 != 0)


@pytest.mark.parametrize("seed", range(5))
def test_isotonic(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 20, 30).astype(float)
    s = rng.random(30) * n
    got = quality_model.isotonic(s, n)
    assert (np.diff(got) >= -1e-12).all() and math.isclose((got * n).sum(), s.sum())
    # the max-min formula of isotonic regression
    c, w = np.r_[0, np.cumsum(s)], np.r_[0, np.cumsum(n)]
    want = [max(min((c[b] - c[a]) / (w[b] - w[a]) for b in range(i + 1, 31)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(got, want)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, len(quality_model.STATISTICS)))
    one = np.ones(x.shape[1])
    f = quality_model.fourier(x, 0 * one, one)[:, 1:]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(f @ f.T - np.exp(-d / (2 * quality_model.WIDTH**2))).mean() < 0.08


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.schema == docs.schema
            n = out.count()
            assert 0.5 * before < n <= before
            docs, before = spark.createDataFrame(out.toPandas(), docs.schema), n
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.select("doc_id").distinct().count() == before
    empty = docs.where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
