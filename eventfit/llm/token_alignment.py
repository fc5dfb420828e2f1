"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both token sequences cover the same bytes. Their end arrays are compared at the
current index shift: an exponential probe jumps over stretches in which the
tokens correspond one to one; where it stops, the irregular group is walked
through locally until both sequences end at the same byte again, which gives
the shift for the next probe.

Documents are taken in parts of bounded size. A part lists its distinct linked
id pairs once, and a document refers to them by number, so that only a part's
pairs are shuffled to be counted and to fetch the corpus-wide counts.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections import ChainMap
from collections.abc import Iterator
from dataclasses import astuple
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Encoder, Vocabulary, vocabulary
from .common import settle, slices

#: Characters of a part; a single longer text forms its own.
PART_CHARS = 2_000_000
#: Words whose pieces a task remembers, and the longest that it does.
REMEMBERED, REMEMBERED_CHARS = 150_000, 48
#: Words that are encoded in one text.
TOGETHER = 256
#: Tokens that the first probe of a stretch compares; the end of a stretch is found among so many one by one.
FIRST_PROBE = 8

PART_SCHEMA = ("part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
               "pair_at array<int>, a array<int>, b array<int>, n array<long>")
_ARROW = pa.schema([*((c, pa.int64()) for c in ("part", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()),
                    *((c, pa.list_(pa.int32())) for c in ("pair_at", "a", "b")), ("n", pa.list_(pa.int64()))])


def stretches(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """One-to-one stretches and irregular groups of two ascending end arrays with the same last end.

    A stretch is ``i, j, length``: its tokens pair up in order. An irregular
    group is ``i, i_end, j, j_end``.
    """
    runs, odd = [], []
    i = j = 0
    n, m = len(ends_a), len(ends_b)
    while i < n:
        # the probe doubles while the ends agree at this shift, and halves again down to the first size
        i0, j0, k = i, j, FIRST_PROBE
        while i + k <= n and j + k <= m and ends_a[i:i + k] == ends_b[j:j + k]:
            i, j = i + k, j + k
            k *= 2
        while k > FIRST_PROBE:
            k //= 2
            if i + k <= n and j + k <= m and ends_a[i:i + k] == ends_b[j:j + k]:
                i, j = i + k, j + k
        while i < n and j < m and ends_a[i] == ends_b[j]:
            i, j = i + 1, j + 1
        if i > i0:
            runs += (i0, j0, i - i0)
        if i == n:
            break
        # an irregular group: the side that is behind goes on until both end at the same byte
        i0, j0 = i, j
        x, y = ends_a[i], ends_b[j]
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        i, j = i + 1, j + 1
        odd += (i0, i, j0, j)
    return np.array(runs, np.int64).reshape(-1, 3), np.array(odd, np.int64).reshape(-1, 4)


def overlaps(odd: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the overlapping tokens of the irregular groups, in order: one pair for each byte at which either token ends."""
    places = [_ranges(odd[:, 2 * c], odd[:, 2 * c + 1] - odd[:, 2 * c]) for c in (0, 1)]
    ends = np.concatenate([ends_a[places[0]], ends_b[places[1]]])
    order = np.argsort(ends, kind="stable")  # of two ascending parts
    ends, of_a = ends[order], order < len(places[0])
    own = np.r_[True, ends[1:] != ends[:-1]][:len(ends)]  # both end where the group does: one pair
    return tuple(at[(np.cumsum(of) - of)[own]] for at, of in zip(places, (of_a, ~of_a), strict=True))


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], list[int], list[int]]:
    """``stretches`` as lists of tuples, and the places of the irregular groups' overlapping tokens."""
    runs, odd = stretches(ends_a, ends_b)
    left, right = overlaps(odd, np.array(ends_a, np.int64), np.array(ends_b, np.int64))
    return list(map(tuple, runs.tolist())), list(map(tuple, odd.tolist())), left.tolist(), right.tolist()


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each range, one after the other."""
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())


def group_ends(runs: list, odd: list) -> tuple[np.ndarray, np.ndarray]:
    """For every group in order where it ends, in both sequences."""
    r = np.array(runs, np.int64).reshape(-1, 3)
    o = np.array(odd, np.int64).reshape(-1, 4)
    ends = [np.sort(np.concatenate([_ranges(r[:, c] + 1, r[:, 2]), o[:, 2 * c + 1]])) for c in (0, 1)]
    return ends[0], ends[1]


def links(runs: list, left: list[int], right: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all linked tokens: those of the stretches, then those of the irregular groups."""
    r = np.array(runs, np.int64).reshape(-1, 3)
    return tuple(np.concatenate([_ranges(r[:, c], r[:, 2]), np.array(odd, np.int64)]) for c, odd in ((0, left), (1, right)))


def ordered_links(runs: np.ndarray, odd: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, groups_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all linked tokens in the order of the text.

    A group of p and q tokens has p + q - 1 links, so a group's first link comes
    after as many as there are tokens before it, less the groups before it.
    """
    out, places = [], []
    for i, j, size in ((runs[:, 0], runs[:, 1], runs[:, 2]), (odd[:, 0], odd[:, 2], odd[:, 1] - odd[:, 0] + odd[:, 3] - odd[:, 2] - 1)):
        places.append(_ranges(i + j - np.searchsorted(groups_a, i, side="right"), size))
    for c, irregular in enumerate(overlaps(odd, ends_a, ends_b)):
        at = np.empty(len(ends_a) + len(ends_b) - len(groups_a), np.int64)
        at[places[0]], at[places[1]] = _ranges(runs[:, c], runs[:, 2]), irregular
        out.append(at)
    return out[0], out[1]


class GroupWriter:
    """Writes groups as ``a1,a2|b1;a3|b2,b3``, the digits of all ids at once."""

    def __init__(self, n_ids: int):
        self.width = len(str(n_ids))
        self.sizes = np.array([len(str(i)) for i in range(n_ids)], np.uint8)
        self.digits = np.frombuffer("".join(str(i).ljust(self.width + 1) for i in range(n_ids)).encode(), np.uint8).reshape(n_ids, -1)

    def text(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
        """The text of the groups that end before ``ends_a`` and ``ends_b``."""
        return self.texts(a, b, ends_a, ends_b, np.array([len(ends_a)]))[0]

    def texts(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The same for each of several texts one after the other, which end before the groups ``cuts``."""
        n = len(a) + len(b)
        # an A token comes after the B tokens of earlier groups, a B token after the A tokens up to its own group
        at_a = np.arange(len(a)) + np.repeat(np.r_[0, ends_b[:-1]], np.diff(np.r_[0, ends_a]))
        at_b = np.arange(len(b)) + np.repeat(ends_a, np.diff(np.r_[0, ends_b]))
        ids, after = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        after[at_a[ends_a - 1]], after[at_b[ends_b - 1]] = ord("|"), ord(";")
        after[at_b[ends_b[cuts - 1] - 1]] = ord("\n")
        table, size = self.digits[ids], self.sizes[ids]
        table[np.arange(n), size] = after
        return table[np.arange(self.width + 1, dtype=np.uint8) <= size[:, None]].tobytes()[:-1].decode().split("\n")


class PieceEncoder:
    """Ids of a sentencepiece model, and the bytes that each of its pieces stands for."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(p) for p in self.bytes], np.int64)
        self.starts, self.flat = np.r_[0, np.cumsum(self.sizes)[:-1]], np.frombuffer(b"".join(self.bytes), np.uint8)
        # where no piece reaches across a blank, texts may be cut there; the blank comes back as the one the model adds
        self.cut = None if any("▁" in p.lstrip("▁") for p in pieces) else re.compile("(?<=[^ ▁]) (?=[^ ▁])")
        self.known: dict[str, bytes] = {}

    def spells(self, ids: np.ndarray, text: bytes) -> bool:
        """Whether the bytes of the pieces give the text."""
        sizes = self.sizes[ids]
        return int(sizes.sum()) == len(text) and bool((self.flat[_ranges(self.starts[ids], sizes)] == np.frombuffer(text, np.uint8)).all())

    def spelt(self, ids: list[np.ndarray], texts: list[bytes]) -> list[int]:
        """Of which texts the bytes of the pieces give back all; none of the texts is empty."""
        sizes = np.array([len(t) for t in texts], np.int64)
        given = np.diff(np.r_[0, np.cumsum(self.sizes[np.concatenate([*ids, np.zeros(0, np.int64)])])][np.cumsum([0, *map(len, ids)])])
        same = np.flatnonzero(sizes == given)
        if not len(same):
            return []
        all_ids = np.concatenate([ids[i] for i in same])
        wrong = self.flat[_ranges(self.starts[all_ids], self.sizes[all_ids])] != np.frombuffer(b"".join([texts[i] for i in same]), np.uint8)
        return same[~np.logical_or.reduceat(wrong, np.r_[0, np.cumsum(sizes[same])[:-1]])].tolist()

    def words(self, text: str) -> list[str]:
        """The text cut at its single blanks, where no piece reaches across."""
        if not self.cut:
            return [text]
        plain = "  " not in text and "▁" not in text and text[:1] != " " and text[-1:] != " "
        return text.split(" ") if plain else self.cut.split(text)

    def code(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word. Words without blanks are encoded many in one
        text, if its pieces give it back: then each blank begins a word's first one."""
        coded = {}
        step = TOGETHER if self.cut else 1
        chunks = [words[i:i + step] for i in range(0, len(words), step)]
        joined = [" ".join(c) for c in chunks]
        for chunk, text, ids in zip(chunks, joined, self.sp.encode(joined, num_threads=1), strict=True):
            flat, want = np.array(ids, np.intc), b" " + text.encode()
            blanks = np.flatnonzero(np.frombuffer(want, np.uint8) == 32)
            if len(chunk) > 1 and len(blanks) == len(chunk) and "▁" not in text and "" not in chunk and self.spells(flat, want):
                sizes = self.sizes[flat]
                cuts = (4 * np.searchsorted(np.cumsum(sizes) - sizes, blanks)).tolist()
                raw = flat.tobytes()
                coded.update((w, raw[s:e]) for w, s, e in zip(chunk, cuts, [*cuts[1:], len(raw)], strict=True))
            else:
                coded.update((w, array("i", x).tobytes()) for w, x in zip(chunk, self.sp.encode(chunk, num_threads=1), strict=True))
        return coded

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; words met before are not encoded again."""
        cut = [self.words(t) for t in texts]
        here = set(chain.from_iterable(cut))
        if len(self.known) > REMEMBERED:
            self.known = {w: self.known[w] for w in here & self.known.keys()}
        new = list(here - self.known.keys())
        coded = self.code(new)
        self.known.update((w, ids) for w, ids in coded.items() if len(w) <= REMEMBERED_CHARS)
        look = ChainMap(coded, self.known).__getitem__ if any(len(w) > REMEMBERED_CHARS for w in new) else self.known.__getitem__
        return [np.frombuffer(b"".join(map(look, ws)), np.intc).astype(np.int64) for ws in cut]


class _Part:
    """The rows of a part and its distinct pairs."""

    def __init__(self, number: int):
        self.number, self.rows, self.links, self.chars = number, [], [], 0

    def add(self, doc_ids: list, counts: list[tuple], linked: list[np.ndarray]) -> None:
        self.rows += [(i, *c) for i, c in zip(doc_ids, counts, strict=True)]
        self.links += linked

    def batch(self) -> pa.RecordBatch:
        keys, at, total = np.unique(np.concatenate([np.zeros(0, np.int64), *self.links]), return_inverse=True, return_counts=True)
        cuts = np.cumsum([0, *map(len, self.links)])

        def lists(values: np.ndarray, offsets, kind) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

        doc = list(zip(*self.rows, strict=True))
        n, own = len(self.rows), [0] * len(self.rows)
        rows = pa.RecordBatch.from_arrays([
            pa.array([self.number] * n, pa.int64()), *(pa.array(c, pa.int64()) for c in doc[:5]), pa.array(doc[5], pa.string()),
            lists(at, cuts, pa.int32()), *(lists([], [*own, 0], pa.int32()) for _ in range(2)), lists([], [*own, 0], pa.int64())], schema=_ARROW)
        none = pa.nulls(1, pa.int64())
        pairs = pa.RecordBatch.from_arrays([
            pa.array([self.number], pa.int64()), *[none] * 5, pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())),
            lists(keys >> 32, [0, len(keys)], pa.int32()), lists(keys & 0xFFFFFFFF, [0, len(keys)], pa.int32()), lists(total, [0, len(keys)], pa.int64())], schema=_ARROW)
        return pa.Table.from_batches([rows, pairs]).combine_chunks().to_batches()[0]


def _aligner(v, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here refers to itself; looking for it took a tenth of the time
        try:
            yield from parts_of(batches)
        finally:
            gc.enable()

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_encoder, pieces = Encoder(Vocabulary(*v.value)), PieceEncoder(model.value)
        sizes_a = np.array([len(p) for p in byte_encoder.v.pieces], np.int64)
        writer = GroupWriter(max(len(sizes_a), len(pieces.sizes)))

        def aligned(texts: list[str]) -> tuple[list, list]:
            """Counts, groups and links of each text. Texts are aligned one after the other as one: where a text ends, both tokens do."""
            a, b = byte_encoder.encode([" " + t for t in texts]), pieces.encode(texts)
            wants = [b" " + t.encode() for t in texts]
            counts, linked = [(0, 0, 0, 0, "")] * len(texts), [np.zeros(0, np.int64)] * len(texts)
            kept = [i for i in pieces.spelt(b, wants) if texts[i]]
            if not kept:
                return counts, linked
            n_a, n_b, sizes = ([len(x[i]) for i in kept] for x in (a, b, wants))
            a, b = (np.concatenate([x[i] for i in kept]).astype(np.int64) for x in (a, b))
            ends_a, ends_b, cuts = np.cumsum(sizes_a[a]), np.cumsum(pieces.sizes[b]), np.cumsum(n_a)
            if (ends_a[cuts - 1] != np.cumsum(sizes)).any():  # byte-level ids give back every text
                raise ValueError("byte-level ids must cover the text")
            runs, odd = stretches(ends_a.tolist(), ends_b.tolist())
            # a text's end is a group's end, but a stretch may go on behind it
            groups_a, groups_b = group_ends(runs, odd)
            last = np.searchsorted(groups_a, cuts) + 1
            n_groups = np.diff(np.r_[0, last])
            at_a, at_b = ordered_links(runs, odd, ends_a, ends_b, groups_a)
            pairs = a[at_a] << 32 | b[at_b]
            n_links = np.array(n_a) + np.array(n_b) - n_groups
            groups = writer.texts(a, b, groups_a, groups_b, last)
            for i, *row, own in zip(kept, n_a, n_b, n_groups.tolist(), n_links.tolist(), groups, np.split(pairs, np.cumsum(n_links)[:-1]), strict=True):
                counts[i], linked[i] = tuple(row), own
            return counts, linked

        first = TaskContext.get().partitionId() << 32
        part = _Part(first)
        for rows in slices(batches):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            if part.rows and part.chars + sum(map(len, texts)) > PART_CHARS:
                yield part.batch()
                part = _Part(part.number + 1)
            part.add(rows.column("doc_id").to_pylist(), *aligned(texts))
            part.chars += sum(map(len, texts))
        if part.rows:
            yield part.batch()

    return run


def aligned_parts(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """Rows of two kinds, by part: documents with their groups, and one row per part with its distinct pairs.

    A document row has its counts, ``groups`` as text, and ``pair_at``: of each of
    its links the number of the pair in its part. A part row (``a``
    is not null and ``n_a`` is) lists the pairs ``a``, ``b`` with their number
    ``n`` in the part. Numbers of parts are those of one run: write the result
    before it is read twice.
    """
    sc = docs.sparkSession.sparkContext
    with open(piece_file, "rb") as f:
        model = sc.broadcast(f.read())
    v = sc.broadcast(astuple(vocabulary(byte_file, special_tokens=False)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligner(v, model), PART_SCHEMA)


def pair_counts(parts: DataFrame) -> DataFrame:
    """``a, b, links, is_best``: corpus-wide number of links of every id pair, and whether it is its B id's highest."""
    pairs = parts.where("n_a is null").select(F.inline(F.arrays_zip("a", "b", "n")))
    counts = settle(pairs.groupBy("a", "b").agg(F.sum("n").alias("links")), "pair_counts")
    # one row per id of the second vocabulary: bounded by its size
    best = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(F.broadcast(best), "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("is_best"))


def _scorer(key, docs: pa.Table, found: pa.Table) -> pa.Table:
    size = 1 + max(found.column("k").to_numpy().max() if len(found) else -1, -1)
    links, best = np.zeros(size, np.int64), np.zeros(size, bool)
    if len(found):
        k = found.column("k").to_numpy()
        links[k], best[k] = found.column("links").to_numpy(), found.column("is_best").to_numpy(zero_copy_only=False)
    at = docs.column("pair_at").combine_chunks()
    flat = at.flatten().to_numpy()
    ends = np.cumsum([0, *pa.compute.list_value_length(at).to_pylist()])
    sums = [np.r_[0, np.cumsum(v[flat], dtype=np.int64)] for v in (best, links)]
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    for name, s in zip(("n_best", "count_sum"), sums, strict=True):
        out = out.append_column(name, pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()))
    return out


def align_documents(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """Counts of the alignment of each row of ``docs(doc_id, text)``, with corpus-wide link counts.

    A: a blank and the text by the byte-level tokenizer, special strings as
    plain text; B: the text by the piece model, which adds the blank. Null and
    empty texts, and those that B doesn't give back byte by byte (they hold
    the model's own sign for a blank), have no tokens: zeros and ''. Ids may be
    null or repeated, each row is answered and counted; ties for an id's
    highest count are all best; other columns, also of clashing names, are
    ignored; an empty table gives an empty result. A very long text is encoded
    word by word and forms a part of its own, which one task holds.
    """
    parts = aligned_parts(docs, byte_file, piece_file)
    parts = settle(parts.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))).drop("groups"), "aligned")
    counts = pair_counts(parts)
    numbered = parts.where("n_a is null").select("part", F.posexplode(F.arrays_zip("a", "b")).alias("k", "p")).select("part", "k", "p.a", "p.b")
    found = numbered.join(counts, ["a", "b"]).select(F.col("part").alias("of_part"), "k", "links", "is_best")
    rows = parts.where("n_a is not null").select("part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair_at")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("part").cogroup(found.groupBy("of_part")).applyInArrow(_scorer, schema)
