"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Texts are cut into pre-tokens by the character classes of the tokenizer's own
pre-tokenizer, with array operations over all texts of a slice. The distinct
pre-tokens are laid out as symbols of one flat array; in a round every
pre-token applies its lowest-ranked pair, looked up by binary search over the
sorted pair keys, and finished pre-tokens leave the array. Long pre-tokens
have too many rounds for that; they are merged rank by rank through linked
places, so that their work grows with their length and not with its square.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import ChainMap
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

LETTER, DIGIT, OTHER, SPACE, BREAK = range(5)
#: Code points that no text can hold: the end of a text, and from the next one on the special tokens.
END, SPECIALS = 0xD800, 0xD801
#: Characters looked at together, symbols from which a pre-token is merged rank by rank,
#: and the bounds of the pre-tokens that a task remembers.
WINDOW_CHARS, LONG_WORD, REMEMBERED, REMEMBERED_BYTES = 4_000_000, 192, 200_000, 64
_NONE = np.int32(2**31 - 1)


@dataclass
class Vocabulary:
    """A byte-level BPE vocabulary; its size is that of the tokenizer's file.

    ``keys`` (left id << 32 | right id, ascending) with the rank of the pair and
    the id of its merge; ``byte_ids`` of the 256 bytes; ``classes`` of all code
    points; ``special`` strings and ids; ``pieces``: the bytes of every id.
    """

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray
    classes: np.ndarray
    special: list[tuple[str, int]]
    pieces: list[bytes]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable bytes themselves, the others from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes(pre_tokenizer) -> np.ndarray:
    """The class of every code point, asked of the library's pre-tokenizer (its Unicode tables decide, not ours)."""
    classes = np.full(0x110000, OTHER, np.uint8)
    step = 256
    for low in [*range(0, 0x40000, step), *range(0xE0000, 0xE1000, step)]:  # Unicode leaves the other planes unassigned or private
        points = np.arange(low, low + step)
        points = points[(points < END) | (points > 0xDFFF)]
        if not len(points):
            continue

        def starts(unit: str, width: int, points=points) -> np.ndarray:
            text = "".join(unit.replace("?", chr(c)) for c in points.tolist())
            at = np.zeros(len(points) * width + 1, bool)
            at[[span[0] for _, span in pre_tokenizer.pre_tokenize_str(text)]] = True
            return at[:-1].reshape(-1, width)

        run = starts("a?1", 3)
        classes[points[~run[:, 1]]] = LETTER
        classes[points[run[:, 1] & ~run[:, 2]]] = DIGIT
        apart = starts("!?!a", 4)
        classes[points[run[:, 1] & run[:, 2] & (apart[:, 1] | apart[:, 2])]] = SPACE
    classes[ord(" ")] = SPACE
    classes[END:0xE000] = BREAK
    return classes


def piece_bytes(spec: dict) -> list[bytes]:
    """The bytes of every id of a tokenizer's file; nothing for ids it lacks."""
    alphabet, vocab, added = byte_alphabet(), spec["model"]["vocab"], spec.get("added_tokens", [])
    pieces = [b""] * (max([*vocab.values(), *(t["id"] for t in added)]) + 1)
    for piece, i in vocab.items():
        pieces[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
    for t in added:
        pieces[t["id"]] = t["content"].encode()
    return pieces


def vocabulary(tokenizer_file: str, special_tokens: bool = True) -> Vocabulary:
    """Read the file of a byte-level BPE tokenizer on the driver.

    ``special_tokens``: whether the special tokens' strings inside a text stand
    for those tokens (the library's default) or are ordinary text. Files with
    a normaliser or another pre-tokenizer are refused.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{tokenizer_file} is not a plain byte-level BPE tokenizer")
    added = spec.get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that take in their surroundings are not supported")
    vocab, alphabet = model["vocab"], byte_alphabet()
    pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
    made = {a + b: r for r, (a, b) in enumerate(pairs)}
    if len(made) < len(pairs) or any(made.get(part, -1) >= r for r, pair in enumerate(pairs) for part in pair):
        raise ValueError("merges must make each piece once, and before they use it")
    rows = sorted((vocab[a] << 32 | vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(pairs))
    keys, ranks, merged = (np.array([x[j] for x in rows], t) for j, t in ((0, np.int64), (1, np.int32), (2, np.int32)))
    byte_ids = np.zeros(256, np.int32)
    for c, b in alphabet.items():
        byte_ids[b] = vocab[c]
    special = [(t["content"], t["id"]) for t in added] if special_tokens else []
    return Vocabulary(keys, ranks, merged, byte_ids, character_classes(Tokenizer.from_file(tokenizer_file).pre_tokenizer), special, piece_bytes(spec))


def _pairs(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged id of each pair of symbols by binary search; rank ``_NONE`` where there is none."""
    key = left.astype(np.int64) << 32 | right
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    return np.where(v.keys[at] == key, v.ranks[at], _NONE), v.merged[at]


def _alternate(starts_run: np.ndarray) -> np.ndarray:
    """Of neighbours that would overlap, every other one, from the left of their run on."""
    run = np.flatnonzero(starts_run)
    place = np.arange(len(starts_run)) - np.repeat(run, np.diff(np.r_[run, len(starts_run)]))
    return place % 2 == 0


def _merge_short(sym: np.ndarray, word: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Rounds in which each word applies its lowest-ranked pair wherever it stands; returns symbols and their words."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        rank, merged = _pairs(v, sym[:-1], sym[1:])
        rank = np.append(np.where(word[:-1] == word[1:], rank, _NONE), _NONE)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
        over = low == _NONE
        if over.any():
            done.append((sym[over], word[over]))
        hit = np.flatnonzero((rank == low) & ~over)
        if not len(hit):
            break
        hit = hit[_alternate(np.r_[True, (np.diff(hit) != 1)])]
        sym[hit] = merged[hit]
        keep = ~over
        keep[hit + 1] = False
        sym, word = sym[keep], word[keep]
    syms, words = (np.concatenate([d[j] for d in done] or [np.zeros(0, np.int32)]) for j in (0, 1))
    order = np.argsort(words, kind="stable")
    return syms[order], words[order]


def _merge_long(sym: np.ndarray, word: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The same for long words: ranks in ascending order, each at all its places at once.

    A merge only makes pairs of higher rank than its own, so one sweep over the
    ranks is enough; symbols are linked to their neighbours.
    """
    n = len(sym)
    after, before = np.arange(1, n + 1), np.arange(-1, n)
    sym, alive = np.append(sym, np.int32(0)), np.ones(n, bool)
    word_at = np.append(word, -1)

    def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nxt = after[at]
        rank, merged = _pairs(v, sym[at], sym[nxt])
        return np.where(word_at[at] == word_at[nxt], rank, _NONE), merged

    current = np.full(n, _NONE)
    makes = np.zeros(n, np.int32)
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(at: np.ndarray) -> None:
        current[at], makes[at] = ranked(at)
        at = at[current[at] < _NONE]
        order = np.argsort(current[at], kind="stable")
        at, ranks = at[order], current[at][order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)] if len(at) else []
        for s, e in zip(cuts, cuts[1:], strict=False):
            r = int(ranks[s])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(queue, r)
            waiting[r].append(at[s:e])

    enter(np.arange(n))
    while queue:
        r = heapq.heappop(queue)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[current[at] == r]
        if not len(at):
            continue
        hit = at[_alternate(np.r_[True, after[at[:-1]] != at[1:]])]
        gone = after[hit]
        sym[hit] = makes[hit]
        alive[gone], current[gone] = False, _NONE
        after[hit] = after[gone]
        before[after[hit]] = hit
        left = before[hit]
        enter(np.unique(np.concatenate([hit, left[left >= 0]])))
    return sym[:n][alive], word[alive]


def encode_words(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """The ids (little-endian, 32 bits) of each pre-token."""
    if not words:
        return []
    sizes = np.array([len(w) for w in words], np.int64)
    sym = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    long = np.repeat(sizes >= LONG_WORD, sizes)
    parts = [_merge_short(sym[~long], word[~long], v), _merge_long(sym[long], word[long], v)]
    sym, word = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
    order = np.argsort(word, kind="stable")
    ends = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
    flat = sym[order].astype("<i4").tobytes()
    return [flat[s:e] for s, e in zip([0, *ends], ends, strict=False)]


def word_starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in an array of code points.

    Letters, digits and other signs form runs, each with the one blank before
    it; white space before something else gives up its last character; an
    apostrophe at the beginning of a run takes in the English endings.
    """
    n = len(points)
    kind = classes[points]
    edge = np.r_[True, kind[1:] != kind[:-1]] | (kind == BREAK)
    space = kind == SPACE
    follows = np.zeros(n, bool)  # something other than white space or the end comes next
    follows[:-1] = (kind[1:] != SPACE) & (kind[1:] != BREAK)
    last = space & follows
    blank = last & (points == 32)
    start = edge | last
    start[1:] &= ~blank[:-1]
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        padded = np.append(points, [END, END])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hits, size in ((short, 2), (long, 3)):
            at = quote[hits]
            for k in range(1, size):
                start[at + k] = False
            at = at[at + size < n]
            start[at + size] |= ~blank[at + size - 1]
    return np.flatnonzero(start)


def split_words(text: str, classes: np.ndarray, window: int = WINDOW_CHARS) -> Iterator[list[bytes]]:
    """The pre-tokens of a text, ``window`` characters at a time; only whole ones are given out."""
    at, size = 0, window
    while at < len(text):
        part = text[at:at + size]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = word_starts(points, classes)
        if at + size < len(text):  # the last two may go on behind the window
            if len(starts) < 4:
                size *= 2
                continue
            starts, end = starts[:-2], int(starts[-2])
        else:
            end = len(part)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.r_[0, np.cumsum(width)]
        data = part.encode("utf-8", "surrogatepass")
        cuts = place[np.append(starts, end)].tolist()
        yield [data[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]
        at, size = at + end, window


class Encoder:
    """Encodes texts, remembering the ids of the pre-tokens it has met within fixed bounds."""

    def __init__(self, v: Vocabulary):
        self.v = v
        marks = {text: chr(SPECIALS + i) for i, (text, _) in enumerate(v.special)}
        self.marks = marks
        self.find = re.compile("|".join(re.escape(t) for t in sorted(marks, key=len, reverse=True))) if marks else None
        self.fixed = {chr(SPECIALS + i).encode("utf-8", "surrogatepass"): np.array([n], "<i4").tobytes() for i, (_, n) in enumerate(v.special)}
        self.fixed[chr(END).encode("utf-8", "surrogatepass")] = b""
        self.known: dict[bytes, bytes] = dict(self.fixed)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        end = chr(END)
        joined = "".join(t + end for t in texts)
        if self.find:
            joined = self.find.sub(lambda m: self.marks[m[0]], joined)
        mark, found, buffer = end.encode("utf-8", "surrogatepass"), [], []
        for words in split_words(joined, self.v.classes):
            met = set(words)
            if len(self.known) > REMEMBERED:  # words that are still in use stay
                self.known = self.fixed | {w: self.known[w] for w in met & self.known.keys()}
            known = self.known
            new = list(met - known.keys())
            here = dict(zip(new, encode_words(new, self.v), strict=True))
            known.update((w, ids) for w, ids in here.items() if len(w) <= REMEMBERED_BYTES)
            look = known.__getitem__ if max(map(len, new), default=0) <= REMEMBERED_BYTES else ChainMap(here, known).__getitem__
            at = 0
            while True:
                try:
                    to = words.index(mark, at)
                except ValueError:
                    break
                buffer.append(b"".join(map(look, words[at:to])))
                found.append(np.frombuffer(b"".join(buffer), "<i4"))
                buffer, at = [], to + 1
            buffer.append(b"".join(map(look, words[at:])))
        return found


def _encode(v):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*v.value))
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for part in slices(batches):
            ids = encoder.encode([t or "" for t in part.column("text").to_pylist()])
            sizes = np.array([0, *map(len, ids)], np.int64)
            if sizes.sum() >= 2**31:
                raise ValueError("a slice of more than 2^31 tokens")
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], schema=schema)

    return run


def encode_documents(docs: DataFrame, tokenizer_file: str, special_tokens: bool = True) -> DataFrame:
    """``doc_id, ids`` of each row of ``docs(doc_id, text)``, as the tokenizers library encodes the whole text.

    Null and empty texts have no ids; ids of documents may be null or repeated,
    each row is answered; ties cannot arise, as every merge has a rank of its
    own; other columns, also of clashing names, are ignored; an empty table
    gives an empty result. Very long texts are read in windows and pre-tokens
    of any length merged in n log n; a text's ids are held by one task.
    Nothing is shuffled.
    """
    v = docs.sparkSession.sparkContext.broadcast(astuple(vocabulary(tokenizer_file, special_tokens)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(v), "doc_id long, ids array<int>")


def _decode(pieces, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.value
        for part in batches:
            texts = []
            for ids in part.column(part.schema.get_field_index(column)):
                flat = () if ids.values is None else ids.values.drop_null().to_numpy().tolist()
                texts.append(b"".join([table[i] for i in flat if 0 <= i < len(table)]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return run


def decode_documents(rows: DataFrame, tokenizer_file: str, column: str = "ids") -> DataFrame:
    """``rows`` with the text of the ids in ``column`` as ``decoded``, special tokens included.

    Bytes that are no UTF-8 become the replacement character; ids outside the
    vocabulary and null ids give nothing; null and empty lists give an empty
    text; a column ``decoded`` is replaced, other columns, repeated rows and
    null ids of documents stay as they are; an empty table stays empty.
    """
    rows = rows.drop("decoded")
    with open(tokenizer_file, encoding="utf-8") as f:
        table = rows.sparkSession.sparkContext.broadcast(piece_bytes(json.load(f)))
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(_decode(table, column), schema)
