"""N-best segmentation into pieces, and decoding.

The pieces of a vocabulary span a lattice over a text. A forward Viterbi pass
gives the best score up to every place; they are exact heuristics for an A*
search that runs backward from the end and completes the paths in order of
their scores. No piece reaches from one word into the next (a word begins with
its spaces), so the lattice of a text is a chain of word lattices: words are
treated on their own, and the N best of the text follow from the words whose
alternatives cost least. The forward pass runs over all new words of a slice at
once, as arrays; it also gives each word's second score, and so tells which few
words of a text can change in its N best. Only these are searched backward.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import slices

SPACE = "▁"
N_BEST = 3
#: Bytes of words that a task remembers; characters in one forward pass; longer words are searched one by one.
REMEMBERED_BYTES, PASS_CHARS, LONGEST = 24 << 20, 40_000, 48
#: Characters of the texts that are handled at once.
TEXT_CHARS = 500_000
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
#: A character that no piece covers is read as its bytes, at the lowest score less this.
UNKNOWN = 10
#: Scores below this mark pieces that the vocabulary adds by rule; they count as the lowest one.
ADDED_BY_RULE = -1e8
#: The score of a segmentation that does not exist.
NONE = -(1 << 60)


class Lattice:
    """Pieces with whole-number scores, so that sums are exact and ties are ties."""

    def __init__(self, pieces: dict[str, tuple[int, int]], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for _, s in pieces.values()), default=0) - UNKNOWN
        self.firsts: dict[str, int] = {}  # longest piece that begins so
        for p in pieces:
            self.firsts[p[0]] = max(len(p), self.firsts.get(p[0], 0))

    def into(self, text: str, end: int) -> list[tuple[int, tuple[int, ...], int]]:
        """The arcs that end at a place: ``(start, ids, score)``, longest first."""
        get = self.pieces.get
        out = [(i, (p[0],), p[1]) for i in range(max(0, end - self.longest), end) if (p := get(text[i:end])) is not None]
        if not out or out[-1][0] != end - 1:
            out.append((end - 1, tuple(self.byte_ids[b] for b in text[end - 1].encode("utf-8", "surrogatepass")), self.unknown))
        return out

    def forward(self, text: str) -> list[int]:
        """The best score of the text up to every place."""
        get, size = self.pieces.get, len(text)
        best = [0] + [NONE] * size
        for i, c in enumerate(text):
            here = best[i]
            for j in range(i + 1, min(size, i + self.firsts.get(c, 1)) + 1):
                if (p := get(text[i:j])) is not None:
                    if here + p[1] > best[j]:
                        best[j] = here + p[1]
                elif j == i + 1 and here + self.unknown > best[j]:
                    best[j] = here + self.unknown
        return best

    def nbest(self, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best segmentations as ``(score, ids)``, best first; of equal ones those with longer pieces from the end on.

        Open hypotheses stand for disjoint sets of paths, each with a best
        completion whose score is known exactly; so no more than the best
        ``n`` of them need be kept.
        """
        if not text:
            return [(0, ())]
        best = self.forward(text)
        agenda: list[tuple[int, int, int, int, tuple | None]] = [(-best[-1], 0, len(text), 0, None)]
        done, made = [], 0
        while agenda and len(done) < n:
            _, _, at, score, path = agenda.pop(0)
            if not at:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                done.append((score, tuple(ids)))
                continue
            for i, piece, s in reversed(self.into(text, at)):
                made -= 1
                bisect.insort(agenda, (-(best[i] + score + s), made, i, score + s, (piece, path)))
            del agenda[n - len(done):]
        return done


def prefix_tree(pieces: dict[str, tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """The pieces as a tree in arrays: ``(characters, edges, children, ids, scores)``.

    ``edges`` are the sorted keys ``node * len(characters) + character``; a
    node that ends no piece has id -1. Node 0 is the root.
    """
    chars = sorted({c for p in pieces for c in p})
    number = {c: i for i, c in enumerate(chars)}
    children: dict[int, int] = {}
    ids, scores = [-1], [0]
    for piece, (i, score) in pieces.items():
        node = 0
        for c in piece:
            key = node * len(chars) + number[c]
            if key not in children:
                children[key] = len(ids)
                ids.append(-1)
                scores.append(0)
            node = children[key]
        ids[node], scores[node] = i, score
    edges = np.array(sorted(children), np.int64)
    return (np.array([ord(c) for c in chars], np.uint32), edges, np.array([children[k] for k in edges.tolist()], np.int64),
            np.array(ids, np.int64), np.array(scores, np.int64))


def forward_words(words: list[str], tree: tuple[np.ndarray, ...], unknown: int) -> tuple[np.ndarray, ...]:
    """Forward Viterbi over the lattices of many words at once.

    Returns per word the best and the second best score (``NONE`` without
    one), and the arcs of the best segmentation, first to last: ``(best,
    second, word of arc, arc)``. An arc is a piece's id, or ``-1 - code point``
    of a character read as its bytes. Of equal segmentations it is the one with
    longer pieces from the end on, as in ``Lattice.nbest``.
    """
    chars, edges, children, piece_ids, piece_scores = tree
    size = np.array([len(w) for w in words], np.int64)
    base = np.cumsum(size + 1) - (size + 1)
    points = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass") + bytes(4), np.uint32)
    place = np.arange(len(points)) - np.repeat(base, size + 1)  # in its word; a word's last place follows its last character
    code = np.minimum(np.searchsorted(chars, points), len(chars) - 1)
    code = np.where(chars[code] == points, code, -1)
    code[base + size] = -1
    # walk the tree from every character at once, a character further each time
    start = np.flatnonzero(place < np.repeat(size, size + 1))
    node, depth = np.zeros(len(start), np.int64), 0
    arcs = []
    while len(start):
        c = code[start + depth]
        key = node * len(chars) + c
        at = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
        hit = (c >= 0) & (edges[at] == key)
        node = np.where(hit, children[at], 0)
        piece = piece_ids[node]
        depth += 1
        if depth == 1:
            bare = start[piece < 0]
            arcs.append((bare, bare + 1, -1 - points[bare].astype(np.int64), np.full(len(bare), unknown, np.int64)))
        use = piece >= 0
        arcs.append((start[use], start[use] + depth, piece[use], piece_scores[node[use]]))
        start, node = start[hit], node[hit]
    from_, to, arc, score = (np.concatenate(x) for x in zip(*arcs, strict=True))
    # by the place in the word, then the word; of each place the longest first
    order = np.argsort((place[to] * len(points) + to) * (depth + 1) + depth - (to - from_))
    from_, to, arc, score = from_[order], to[order], arc[order], score[order]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    step = place[to[first]]
    best, second = np.zeros(len(points), np.int64), np.full(len(points), NONE, np.int64)
    back = np.zeros(len(points), np.int64)  # the arc taken into each place
    bounds = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        a, b = int(first[lo]), int(first[hi]) if hi < len(first) else len(to)
        heads = first[lo:hi] - a
        group = np.repeat(np.arange(hi - lo), np.diff(np.r_[heads, b - a]))
        one, two = best[from_[a:b]] + score[a:b], second[from_[a:b]] + score[a:b]
        top = np.maximum.reduceat(one, heads)
        won = np.flatnonzero(one == top[group])
        won = won[np.r_[True, group[won[1:]] != group[won[:-1]]]]
        one[won] = NONE
        ends = to[a + heads]
        best[ends], second[ends] = top, np.maximum(np.maximum.reduceat(one, heads), np.maximum.reduceat(two, heads))
        back[ends] = a + won
    # back from the ends of all words
    owner, at = np.arange(len(words)), base + size
    owners, taken = [], []
    while True:
        go = at > base[owner]
        owner, at = owner[go], at[go]
        if not len(owner):
            break
        owners.append(owner)
        taken.append(arc[back[at]])
        at = from_[back[at]]
    owners, taken = np.concatenate([*owners[::-1], np.zeros(0, np.int64)]), np.concatenate([*taken[::-1], np.zeros(0, np.int64)])
    order = np.argsort(owners, kind="stable")
    end = base + size
    return best[end], np.where(second[end] < NONE // 2, NONE, second[end]), owners[order], taken[order]


class Words:
    """The words that a task has met: their two best scores, the ids of their best segmentation, and n-best lists where asked for."""

    def __init__(self, lattice: Lattice, tree: tuple[np.ndarray, ...], n: int):
        self.lattice, self.tree, self.n = lattice, tree, n
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # new words are numbered as they come
        self.names: list[str] = []
        self.lists: dict[int, list[tuple[int, bytes]]] = {}
        self.best = self.second = self.start = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")
        self.bytes = 0

    def numbers(self, words: Iterable[str]) -> np.ndarray:
        """The numbers of a text's words; ``learn`` has to follow before they are used."""
        return np.fromiter(map(self.number.__getitem__, words), np.int64)

    def learn(self) -> None:
        """Find the scores and best segmentations of the words that are new."""
        new = list(islice(self.number, len(self.names), None))
        done = len(self.names)
        self.names += new
        chars = np.cumsum([min(len(w), PASS_CHARS) for w in new])
        found, at = [], 0
        while at < len(new):
            if len(new[at]) > LONGEST:
                end = at + 1
                self.lists[done + at] = best = self._search(new[at])
                second = best[1][0] if len(best) > 1 else NONE
                ids = np.frombuffer(best[0][1], "<u4")
                found.append((np.array([best[0][0]]), np.array([second]), np.array([len(ids)]), ids))
            else:
                end = max(at + 1, int(np.searchsorted(chars, (chars[at - 1] if at else 0) + PASS_CHARS)))
                end = next((i for i in range(at, min(end, len(new))) if len(new[i]) > LONGEST), end)
                found.append(self._pass(new[at:end]))
            at = end
        if not found:
            return
        best, second, size, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.best, self.second = np.concatenate([self.best, best]), np.concatenate([self.second, second])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        self.bytes += 200 * len(new) + 4 * (sum(map(len, new)) + len(ids))

    def _search(self, word: str) -> list[tuple[int, bytes]]:
        return [(s, np.array(ids, "<u4").tobytes()) for s, ids in self.lattice.nbest(word, self.n)]

    def _pass(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Best and second scores of words, and length and ids of their best segmentations."""
        best, second, owner, arc = forward_words(words, self.tree, self.lattice.unknown)
        # characters that no piece covers become their bytes
        bare = np.flatnonzero(arc < 0)
        wide = np.ones(len(arc), np.int64)
        points, which = np.unique(-1 - arc[bare], return_inverse=True)
        raw = [[self.lattice.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in points.tolist()]
        if raw:
            wide[bare] = np.array([len(r) for r in raw], np.int64)[which]
        first = np.cumsum(wide) - wide
        ids = np.zeros(int(wide.sum()), "<u4")
        ids[first[arc >= 0]] = arc[arc >= 0]
        by_point = np.split(bare[np.argsort(which, kind="stable")], np.cumsum(np.bincount(which, minlength=len(raw)))[:-1]) if raw else []
        for r, at in zip(raw, by_point, strict=True):
            ids[first[at][:, None] + np.arange(len(r))] = r
        return best, second, np.bincount(owner, weights=wide, minlength=len(words)).astype(np.int64), ids

    def best_lists(self, word: int) -> list[tuple[int, bytes]]:
        """The n best of a word, searched backward when first asked for."""
        if word not in self.lists:
            self.lists[word] = self._search(self.names[word])
            self.bytes += 300 + 2 * len(self.lists[word]) * len(self.lists[word][0][1])
        return self.lists[word]

    def chain(self, at: np.ndarray) -> list[tuple[int, bytes]]:
        """The n best segmentations of a text, given as the numbers of its words.

        They change only words among the ``n - 1`` whose second choice costs least.
        """
        total, size = int(self.best[at].sum()), self.size[at]
        end = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[at] - (end - size), size) + np.arange(int(size.sum()))].tobytes()
        more = np.flatnonzero(self.second[at] > NONE)
        if self.n == 1 or not len(more):
            return [(total, ids)]
        loss = self.best[at[more]] - self.second[at[more]]
        if len(loss) >= self.n:
            near = loss <= np.partition(loss, self.n - 2)[self.n - 2]
            more, loss = more[near], loss[near]
        open_ = more[np.argsort(loss, kind="stable")[:self.n - 1]].tolist()
        lists = [self.best_lists(int(at[i])) for i in open_]
        out = []
        for lost, choice in chain_nbest([[s for s, _ in x] for x in lists], self.n):
            parts, upto = [], 0
            for i, k, x in sorted(zip(open_, choice, lists, strict=True)):
                if k:
                    parts += [ids[4 * upto:4 * int(end[i] - size[i])], x[k][1]]
                    upto = int(end[i])
            out.append((total - lost, b"".join([*parts, ids[4 * upto:]])))
        return out


def chain_nbest(words: list[list[int]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The ``n`` best combinations of one choice a word, from the words' descending scores: ``(loss, choices)``, searched best first."""
    heap: list[tuple[int, tuple[int, ...]]] = [(0, (0,) * len(words))]
    seen, out = {heap[0][1]}, []
    while heap and len(out) < n:
        cost, choice = heapq.heappop(heap)
        out.append((cost, choice))
        for k, scores in enumerate(words):
            if choice[k] + 1 < len(scores):
                nxt = (*choice[:k], choice[k] + 1, *choice[k + 1:])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (cost + scores[choice[k]] - scores[choice[k] + 1], nxt))
    return out


def load_lattice(model_file: str) -> tuple[dict[str, tuple[int, int]], list[int], list[bytes]]:
    """Pieces and scores, ids of the 256 bytes, and the bytes of each id, of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(size)]
    byte_ids, text_of = [0] * 256, [b""] * size
    pieces = {}
    plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    low = min(s for i in plain if (s := sp.get_score(i)) > ADDED_BY_RULE)
    for i, name in enumerate(names):
        if sp.is_byte(i):
            value = int(name[1:-1], 16)
            byte_ids[value], text_of[i] = i, bytes([value])
    for i in plain:
        pieces[names[i]] = (i, round(max(low, sp.get_score(i))))
        text_of[i] = names[i].replace(SPACE, " ").encode()
    return pieces, byte_ids, text_of


def split_words(text: str) -> Iterable[str]:
    """The words of a text, each with the blanks before it; of a long text they are made one by one."""
    text = SPACE + text.replace(" ", SPACE) if text else ""
    return _WORD.findall(text) if len(text) <= TEXT_CHARS else (m[0] for m in _WORD.finditer(text))


def _segmenter(spec, n: int, decoded: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, byte_ids, text_of, tree = spec.value
        known = Words(Lattice(pieces, byte_ids), tree, n)
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("scores", pa.list_(pa.int64())), ("segmentations", pa.list_(pa.binary()))])
        if decoded:
            schema = schema.append(pa.field("decoded", pa.string()))
        for part in slices(batches, most=TEXT_CHARS):
            if known.bytes > REMEMBERED_BYTES:
                known.clear()
            texts = [known.numbers(split_words(text or "")) for text in part.column("text").to_pylist()]
            known.learn()
            rows = [known.chain(words) for words in texts]
            out = [part.column("doc_id"), part.column("text"), pa.array([[s for s, _ in r] for r in rows], pa.list_(pa.int64())),
                   pa.array([[ids for _, ids in r] for r in rows], pa.list_(pa.binary()))]
            if decoded:
                out.append(pa.array([decode_ids(r[0][1], text_of).decode("utf-8", "replace") for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def segment_documents(docs: DataFrame, model_file: str, n: int = N_BEST, decoded: bool = False) -> DataFrame:
    """``doc_id, text, scores, segmentations`` of each row of ``docs(doc_id, text)``.

    ``segmentations`` holds up to ``n`` id sequences (little-endian unsigned 32
    bits), best first; with ``decoded`` a column of that name holds the text
    that the best one decodes to, as ``decode`` gives it. Null and empty texts have one empty segmentation of
    score 0. Null and repeated ids are answered row by row; of segmentations of
    a word with equal score those with longer pieces from the end on come first;
    a very long text is one task's
    work, word by word; other columns are ignored; an empty table gives an
    empty result.
    """
    lattice = load_lattice(model_file)
    spec = docs.sparkSession.sparkContext.broadcast((*lattice, prefix_tree(lattice[0])))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _segmenter(spec, n, decoded),
        "doc_id long, text string, scores array<long>, segmentations array<binary>" + ", decoded string" * decoded)


def decode_ids(ids: bytes, text_of: list[bytes]) -> bytes:
    """The UTF-8 text of an id sequence, without the blank that encoding puts in front."""
    return b"".join([text_of[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:]


def _decoder(spec, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = spec.value
        for part in slices(batches, column):
            texts = [None if x is None else decode_ids(x, text_of).decode("utf-8", "replace") for x in part.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return run


def decode(segmented: DataFrame, model_file: str, column: str) -> DataFrame:
    """``segmented`` with the text ``decoded`` from the id sequences of a binary column.

    A null sequence gives a null text, an empty one an empty text; rows with
    null or repeated ids and other columns stay as they are (a column
    ``decoded`` must not be among them); an empty table stays empty.
    """
    spec = segmented.sparkSession.sparkContext.broadcast(load_lattice(model_file)[2])
    schema = StructType([*segmented.schema.fields, StructField("decoded", StringType())])
    return segmented.mapInArrow(_decoder(spec, column), schema)
