"""Token counts of a piece vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens (a run of spaces with what follows it; no piece
reaches across). The distinct pre-tokens of a slice are held as one ragged
numpy array of symbols. In every round each pre-token applies its own
lowest-ranked pair, all pre-tokens at once, until none has a pair left; the
surviving symbols are counted. A task keeps the counts of the pre-tokens it
has met in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
TOKEN_LIMIT = 4096
#: Pre-tokens whose counts a task remembers, and the longest that it does.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
_PRETOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")
_NONE = np.int32(2**31 - 1)


@dataclass
class MergeTable:
    """``keys`` (left id << 32 | right id, ascending) with the rank and the id of the merged symbol.

    ``chars`` maps a code point to its id, or to minus the number of its UTF-8
    bytes where the vocabulary lacks it (byte fallback). Pieces of ``shared``
    rank have equal scores, so only the leftmost of them merges in a round.
    """

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    chars: np.ndarray
    shared: np.ndarray


def merge_table(model_file: str) -> MergeTable:
    """The merge table of a sentencepiece BPE model; read on the driver, its size is that of the vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    ids = {p: i for p, i, _ in pieces}
    scores = sorted({s for *_, s in pieces}, reverse=True)
    rank_of = {s: r for r, s in enumerate(scores)}
    times = np.zeros(len(scores), np.int64)
    for *_, s in pieces:
        times[rank_of[s]] += 1
    chars = np.full(0x110000, -4, np.int32)
    chars[:0x10000], chars[:0x800], chars[:0x80] = -3, -2, -1
    rows = []
    for p, i, s in pieces:
        if len(p) == 1:
            chars[ord(p)] = i
        for cut in range(1, len(p)):
            if p[:cut] in ids and p[cut:] in ids:
                rows.append((ids[p[:cut]] << 32 | ids[p[cut:]], rank_of[s], i))
    rows.sort()
    keys, ranks, merged = (np.array([r[j] for r in rows], t) for j, t in ((0, np.int64), (1, np.int32), (2, np.int32)))
    return MergeTable(keys, ranks, merged, chars, times > 1)


def _pairs(table: MergeTable, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged id of each pair of symbols; rank ``_NONE`` where there is none."""
    key = left.astype(np.int64) << 32 | right.astype(np.int64)
    at = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
    known = (table.keys[at] == key) & (left >= 0) & (right >= 0)
    return np.where(known, table.ranks[at], _NONE), table.merged[at]


def count_pretokens(words: list[str], table: MergeTable) -> np.ndarray:
    """Number of tokens of each pre-token."""
    count = np.zeros(len(words), np.int64)
    if not words:
        return count
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym, word = table.chars[points], np.repeat(np.arange(len(words)), sizes)
    count += np.bincount(word, weights=np.where(sym < 0, -sym, 1), minlength=len(words)).astype(np.int64)
    while len(sym) > 1:
        rank, merged = _pairs(table, sym[:-1], sym[1:])
        rank = np.where(word[:-1] == word[1:], rank, _NONE)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        low = np.minimum.reduceat(np.append(rank, _NONE), starts)
        group = np.cumsum(np.r_[True, word[1:] != word[:-1]]) - 1
        low = low[group]
        hit = np.flatnonzero((rank == low[:-1]) & (rank < _NONE))
        if not len(hit):
            break
        # occurrences that overlap: from the left, every other one of a run; ranks that pieces share: the leftmost only
        run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
        place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
        first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
        hit = hit[np.where(table.shared[rank[hit]], first, place % 2 == 0)]
        sym[hit] = merged[hit]
        np.subtract.at(count, word[hit], 1)
        alive = low < _NONE
        alive[hit + 1] = False
        sym, word = sym[alive], word[alive]
    return count


def pretokens(text: str) -> tuple[list[str], int]:
    """Pre-tokens of a text, and the tokens of the parts of long space runs that are left out of them.

    Spaces merge from the left to the vocabulary's longest run of them, 16, so
    whole 16s of a longer run are counted at once.
    """
    if not text:
        return [], 0
    words = _PRETOKEN.findall(SPACE + text.replace(" ", SPACE))
    extra = 0
    if SPACE * 48 in text.replace(" ", SPACE):
        for i, w in enumerate(words):
            spaces = len(w) - len(w.lstrip(SPACE))
            if spaces > 48:
                cut = (spaces - 32) // 16
                extra += cut
                words[i] = w[cut * 16:]
    return words, extra


def _counter(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        merges = MergeTable(*table.value)
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            cut = [pretokens(t) for t in texts]
            if len(known) > REMEMBERED:
                known = {}
            new = list({w for words, _ in cut for w in words} - known.keys())
            here = dict(zip(new, count_pretokens(new, merges).tolist(), strict=True))
            known.update((w, n) for w, n in here.items() if len(w) <= REMEMBERED_CHARS)
            here.update((w, known[w]) for words, _ in cut for w in words if w not in here)
            n = [extra + sum(map(here.__getitem__, words)) for words, extra in cut]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                                              pa.array(n, pa.int64())], schema=schema)

    return run


def count_tokens(docs: DataFrame, model_file: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs(doc_id, text)``.

    Tokens are counted as the sentencepiece library would give them, without
    begin or end marks. Null and empty texts have none; ids may be null or
    repeated, each row is answered; other columns are ignored; an empty table
    gives an empty result. A text is one task's work, in proportion to its
    length; nothing is shuffled.
    """
    table = docs.sparkSession.sparkContext.broadcast(astuple(merge_table(model_file)))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counter(table), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
