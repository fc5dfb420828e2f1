"""Byte-level BPE, token alignment and the filter audit against the libraries and brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventfit.llm import byte_bpe, filter_audit, queries, token_alignment

from .test_text_operators import ODD, odd_docs

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, PLAIN = Tokenizer.from_file(BYTES), Tokenizer.from_file(BYTES)
PLAIN.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)
V = byte_bpe.vocabulary(BYTES)
ENCODER = byte_bpe.Encoder(V)
ALPHABET = [*" \t\n\r\x0b\x0c\x1c\x85  'strevmldST0é門🙂1²a!-_", "<|endoftext|>", "'s", "'re", "'ll", "  "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- byte-level BPE -----------------------------------------------------------------------------------------


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(ALPHABET[:-5]), st.characters(codec="utf-8")), max_size=30), max_size=4),
       st.sampled_from(["", "<|endoftext|>", " <|endoftext|><|endoftext|>\n", "'re"]))
def test_ids_equal_the_library(parts, between):
    text = between.join(parts)
    assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_code_point_is_cut_like_the_library():
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x30000 or c % 97 == 0)]
    texts = [f"a{chr(c)}1 {chr(c)} x\n{chr(c)}" for c in points]
    want = LIBRARY.encode_batch(texts, add_special_tokens=False)
    assert all(g.tolist() == w.ids for g, w in zip(ENCODER.encode(texts), want, strict=True))


def test_windows_cut_the_same_words():
    r = random.Random(5)
    for _ in range(500):
        text = "".join(r.choice(ALPHABET) for _ in range(40)).replace("<|endoftext|>", chr(byte_bpe.SPECIALS)) + chr(byte_bpe.END)
        whole = [w for ws in byte_bpe.split_words(text, V.classes) for w in ws]
        for window in (1, 5, 16):
            assert [w for ws in byte_bpe.split_words(text, V.classes, window) for w in ws] == whole


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 5_000, "é" * 3_000, " " * 100_001 + "x", "=" * 5_000 + "-" * 5_001,
                                  "".join(random.Random(2).choice("abcdefghijklmnop") for _ in range(60_000))], ids=range(6))
def test_long_words(text):
    assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_short_and_long_merging_agree(monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("aabcden ") for _ in range(r.randint(1, 60))).encode() for _ in range(300)]
    want = byte_bpe.encode_words(words, V)
    monkeypatch.setattr(byte_bpe, "LONG_WORD", 1)
    assert byte_bpe.encode_words(words, V) == want


def test_encode_and_decode_documents(spark):
    docs = odd_docs(spark)
    got = byte_bpe.encode_documents(docs, BYTES)
    rows = got.collect()
    texts = {i: t or "" for i, t in enumerate(ODD)} | {None: "no id here"}
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in docs.collect())
    for r in rows:
        assert r.ids == LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
    back = byte_bpe.decode_documents(got.selectExpr("*", "1 as decoded", "'x' as other"), BYTES)
    assert all(r.decoded == texts[r.doc_id] and r.other == "x" for r in back.collect())
    odd = spark.createDataFrame([(1, None), (2, []), (3, [50256, 64, 10**6, -1, None]), (4, [447, 64])], "doc_id long, ids array<int>")
    seen = {r.doc_id: r.decoded for r in byte_bpe.decode_documents(odd, BYTES).collect()}
    assert seen == {1: "", 2: "", 3: "<|endoftext|>a", 4: LIBRARY.decode([447, 64], skip_special_tokens=False)}
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(docs.limit(0), BYTES), BYTES).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))


# ---- alignment ----------------------------------------------------------------------------------------------


def brute_align(text):
    """Token ids and spans of both tokenizers, their links by comparing all pairs, and the groups by the common ends."""
    if not text:
        return None
    a = PLAIN.encode(" " + text, add_special_tokens=False).ids
    b = SP.encode(text)
    spell = {"a": [V.pieces[i] for i in a], "b": []}
    for i in b:
        p = SP.id_to_piece(i)
        spell["b"].append(bytes([int(p[3:5], 16)]) if SP.is_byte(i) else p.replace("▁", " ").encode())
    if b"".join(spell["b"]) != (" " + text).encode() or b"".join(spell["a"]) != (" " + text).encode():
        return None
    ends = {k: list(itertools.accumulate(map(len, v))) for k, v in spell.items()}
    links = [(i, j) for i, e in enumerate(ends["a"]) for j, f in enumerate(ends["b"])
             if max(e - len(spell["a"][i]), f - len(spell["b"][j])) < min(e, f)]
    groups, low = [], 0
    for c in sorted(set(ends["a"]) & set(ends["b"])):
        groups.append("|".join(",".join(str(t) for t, e in zip(ids, ends[k], strict=True) if low < e <= c) for k, ids in (("a", a), ("b", b))))
        low = c
    return a, b, groups, [(a[i], b[j]) for i, j in links]


def brute_documents(texts):
    found = [brute_align(t) for t in texts]
    count = collections.Counter(p for f in found if f for p in f[3])
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(count[p] == most[p[1]] for p in f[3]), sum(count[p] for p in f[3]), sha(";".join(f[2])))
            if f else (0, 0, 0, 0, 0, 0, "") for f in found]


@settings(max_examples=400, deadline=None)
@given(st.sets(st.integers(1, 90), max_size=60), st.sets(st.integers(1, 90), max_size=60), st.sampled_from([1, 2, 8]), st.booleans())
def test_align_equals_common_ends(x, y, probe, near):
    y = (x | {v for v in y if v % 9 == 0}) - {v for v in y if v % 11 == 0} if near else y
    ends_a, ends_b = sorted({*x, 91}), sorted({*y, 91})
    token_alignment.FIRST_PROBE, before = probe, token_alignment.FIRST_PROBE
    try:
        runs, odd, left, right = token_alignment.align(ends_a, ends_b)
    finally:
        token_alignment.FIRST_PROBE = before
    groups = token_alignment.group_ends(runs, odd)
    common = sorted(set(ends_a) & set(ends_b))
    assert [g.tolist() for g in groups] == [[ends.index(c) + 1 for c in common] for ends in (ends_a, ends_b)]
    spans = [[(s, e) for s, e in zip([0, *ends], ends, strict=False)] for ends in (ends_a, ends_b)]
    got = sorted(zip(*(p.tolist() for p in token_alignment.links(runs, left, right)), strict=True))
    assert got == [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (p, q) in enumerate(spans[1]) if max(s, p) < min(e, q)]
    a, b = [7 * i for i in range(len(ends_a))], [10**i % 9973 for i in range(len(ends_b))]
    text, low = [], (0, 0)
    for i, j in zip(*(g.tolist() for g in groups), strict=True):
        text.append(f"{','.join(map(str, a[low[0]:i]))}|{','.join(map(str, b[low[1]:j]))}")
        low = (i, j)
    assert token_alignment.GroupWriter(10_000).text(np.array(a), np.array(b), *groups) == ";".join(text)


@pytest.mark.parametrize("seed", range(6))
def test_links_come_in_the_order_of_the_text_without_being_sorted(seed):
    """They were listed one by one, stretches first, and sorted by text afterwards."""
    rng = np.random.default_rng(seed)
    size = [1, 40, 3000][seed % 3]
    same = rng.random(size) < [0.2, 0.9][seed % 2]
    ends = [np.flatnonzero(np.append(same | (rng.random(size) < 0.3), True)) + 1 for _ in range(2)]
    runs, odd = token_alignment.stretches(*(e.tolist() for e in ends))
    groups, _ = token_alignment.group_ends(runs, odd)
    got = token_alignment.ordered_links(runs, odd, *ends, groups)
    both = np.union1d(*ends)  # one link for each byte at which either token ends
    for at, e in zip(got, ends, strict=True):
        assert at.tolist() == np.searchsorted(e, both).tolist()


def alignment_rows(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("part_chars", [1, 3_000, token_alignment.PART_CHARS])
def test_align_documents(spark, monkeypatch, part_chars):
    monkeypatch.setattr(token_alignment, "PART_CHARS", part_chars)
    short = [t[:400] if t else t for t in ODD]
    rows = [(i, t, "x", 7) for i, t in enumerate([*short, "the same text", "the same text", "unbelievable tokenization of words"])]
    rows += [(None, "no id", "x", 7), (3, short[3], "x", 7), (3, short[3], "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, part int").repartition(3)
    want = brute_documents([r[1] for r in rows])
    assert alignment_rows(token_alignment.align_documents(docs, BYTES, PIECES)) == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))
    assert token_alignment.align_documents(docs.limit(0), BYTES, PIECES).collect() == []


def test_words_give_the_pieces_of_the_text(monkeypatch):
    with open(PIECES, "rb") as f:
        encoder = token_alignment.PieceEncoder(f.read())
    r = random.Random(8)
    texts = [*filter(None, ODD), "", "some words  and   more of them " * 40, "x" * 200 + " y",
             *("".join(r.choice([*ALPHABET, " ", " a", "the ", "▁", "  "]) for _ in range(60)) for _ in range(2000))]
    monkeypatch.setattr(token_alignment, "REMEMBERED", 500)
    for k in range(0, len(texts), 50):
        assert [ids.tolist() for ids in encoder.encode(texts[k:k + 50])] == SP.encode(texts[k:k + 50])


def test_alignment_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in queries.op11(spark, sf).collect()}
    assert len(rows) == len(docs)
    spell = [len(p) for p in V.pieces]
    for d in docs:
        if len(d.text or "") < 3_000:
            f = brute_align(d.text or "")
            r = rows[d.doc_id]
            assert (r.n_a, r.n_b, r.n_groups, r.n_links) == ((len(f[0]), len(f[1]), len(f[2]), len(f[3])) if f else (0, 0, 0, 0))
            assert r.groups_sha256 == (sha(";".join(f[2])) if f else "")
            assert r.n_best <= r.n_links <= r.count_sum
            assert not f or sum(spell[i] for i in f[0]) == len(d.text.encode()) + 1


# ---- filter audit -------------------------------------------------------------------------------------------


def brute_failures(rows):
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = doc_id is not None and any(o is not None and o < doc_id and (u or "") == t for o, u, _ in rows)
        out.append({f for f, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
                                     ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", re.search(r"[#$%&*|]", t)), ("E", e)) if bad})
    return out


def brute_audit(rows, labels):
    fails = brute_failures(rows)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out = {}
    for part in {r[2] or "" for r in rows}:
        here = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for step, own in enumerate(order, 1):
                gone, left = [x for x in left if own in x[1]], [x for x in left if own not in x[1]]
                total[own] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(own in f for _, f in here) - len(gone), sum(f == {own} for _, f in here),
                                          sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_audit_equals_applying_the_filters(spark):
    r = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "delta#", "é門", "x", "y", "z w", "q\x1cr"]
    texts = [None, "", " \n", "A", "# $", *(" ".join(r.choice(words[:r.randint(1, 9)]) + (str(r.randint(0, 300)) if r.random() < 0.7 else "")
                                            for _ in range(r.choice([3, 199, 200, 260]))) for _ in range(60))]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(None, texts[5], "en"), (None, texts[5], "en"), rows[3], rows[3], (7, "other text", "fr")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 150, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    docs = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, lang string, part int, failed string")
    got = filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(x) for x in got.collect()) == brute_audit(rows, labels)
    assert filter_audit.audit_filters(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 4 and 97 + x % 3 or 32 + x % 2 for x in b)), st.integers(1, 9))
def test_words_in_windows(data, window):
    assert filter_audit.word_counts(data, window) == filter_audit.word_counts(data)


def test_tensor_axes():
    tensor = np.zeros((2,) * 5, np.int64)
    tensor[1, 0, 0, 0, 1] = 3
    steps, chosen = filter_audit.selectors()
    at = steps.index(("EABCD", 2))
    assert filter_audit.contract(tensor, chosen["removed"])[at] == 0
    assert filter_audit.contract(tensor, chosen["failing"])[at] == 3
    assert len(steps) == 600


def test_piece_encoder_codes_many_words_in_one_call():
    """Words were encoded one by one; words that the model changes, and those with blanks of their own, still are."""
    with open(PIECES, "rb") as f:
        pieces = token_alignment.PieceEncoder(f.read())
    words = [f"word{i}x" for i in range(600)] + ["Straße", "日本語", "a\u3000b", "ﬁn", "", "a  b", "▁x", "<s>", "e\u0301", "\t", "x" * 300]
    seen = []
    encode = pieces.sp.encode
    pieces.sp.encode = lambda texts, **k: seen.append(len(texts)) or encode(texts, **k)
    got = pieces.code(words)
    assert {w: np.frombuffer(got[w], np.intc).tolist() for w in words} == {w: SP.encode(w) for w in words}
    assert sum(seen) < len(words) / 2
