"""Best-fit packing of tokenised documents, improved by swaps between bins.

Documents are encoded, ended with a separator, and cut into pieces of at most
one sequence. Pieces are dealt by a hash into groups of bounded size; each
group is packed best-fit, longest first, and then improved by local search:
pieces are moved, or exchanged one for one or two for one, between bins that
are not full, whenever that raises the sum of squared fills. Fuller bins get
fuller, emptier ones emptier, until bins run empty and vanish.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices

SEQUENCE_TOKENS = 2048
SEPARATOR = 0
#: Pieces packed together, on average; a group is one task's memory.
GROUP_PIECES = 8_192
#: Rounds of local search, and the bins that a round looks at from the emptiest on.
ROUNDS, OPEN_BINS = 6, 2_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary, row_key long"


class ByteLevelEncoder:
    """Encodes like the ``tokenizers`` library does with a byte-level BPE file, by the same vocabulary's ranks."""

    def __init__(self, json_text: str, pattern: str):
        import json

        import tiktoken

        spec = json.loads(json_text)
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        back = {c: b for b, c in shown.items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in p): i for p, i in spec["model"]["vocab"].items() if p not in special}
        self.special = special
        self.encoding = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, allowed_special="all"), dtype="<u4")


def cut(length: int, limit: int = SEQUENCE_TOKENS) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document; of a longer one only the first may be short."""
    if length <= limit:
        return [(0, length)]
    first = length % limit
    return ([(0, first)] if first else []) + [(at, limit) for at in range(first, length, limit)]


def _encoder(spec, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteLevelEncoder(*spec.value)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                            ("ids", pa.binary()), ("row_key", pa.int64())])
        for part in slices(batches):
            rows = []
            for doc_id, text, key in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "row_key")), strict=True):
                ids = np.append(encoder.encode(text or ""), np.uint32(SEPARATOR)).astype("<u4")
                rows += [(doc_id, i, at, n, ids[at:at + n].tobytes(), key) for i, (at, n) in enumerate(cut(len(ids), limit))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def token_pieces(docs: DataFrame, tokenizer_file: str, pattern: str, limit: int = SEQUENCE_TOKENS) -> DataFrame:
    """The pieces of each row of ``docs(doc_id, text)`` with their token ids (little-endian, unsigned, 32 bits)."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key")).mapInArrow(_encoder(spec, limit), PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, limit: int = SEQUENCE_TOKENS) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []  # the rooms for which there is a bin, ascending
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(i)
        else:
            room, b = limit, len(bins)
            bins.append([i])
        left = room - n
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, limit: int = SEQUENCE_TOKENS, rounds: int = ROUNDS) -> list[list[int]]:
    """Local search over the bins that are not full.

    Every open bin, emptiest first, offers each of its pieces to fuller bins:
    to move in where it fits, to replace one shorter piece, or to replace two
    pieces that are shorter together, whatever fills the other bin most. Each
    step takes the receiving bin nearer to its limit and so raises the sum of
    squared fills; it stops when a round finds no step.
    """
    size = lengths.tolist()
    for _ in range(rounds):
        fill = [sum(size[i] for i in b) for b in bins]
        open_ = sorted((b for b in range(len(bins)) if 0 < fill[b] < limit), key=lambda b: (fill[b], b))[:OPEN_BINS]
        steps = 0
        for low in open_:
            for i in sorted(bins[low], key=lambda i: -size[i]):
                step = _best_step(i, low, open_, bins, fill, size, limit)
                if step is None:
                    continue
                high, out = step
                back = sum(size[j] for j in out)
                bins[high] = [j for j in bins[high] if j not in out] + [i]
                bins[low] = [j for j in bins[low] if j != i] + out
                fill[high] += size[i] - back
                fill[low] += back - size[i]
                steps += 1
        bins = [b for b in bins if b]
        if not steps:
            break
    return bins


def _best_step(i: int, low: int, open_: list[int], bins, fill, size, limit: int) -> tuple[int, list[int]] | None:
    """The bin, and the pieces it gives back for piece ``i``, with the largest rise of squared fills."""
    best, found = 0, None
    n = size[i]
    for high in open_[:-65:-1]:  # the fullest open bins
        room = limit - fill[high]
        if high == low or fill[high] < fill[low] or not room:
            continue
        gain = 0
        if n <= room:
            gain, out = n, []
        else:
            for j in bins[high]:
                if size[j] < n and n - size[j] <= room and n - size[j] > gain:
                    gain, out = n - size[j], [j]
            if gain < room and len(bins[high]) < 64:
                for x, j in enumerate(bins[high]):
                    for k in bins[high][x + 1:]:
                        two = size[j] + size[k]
                        if two < n and n - two <= room and n - two > gain:
                            gain, out = n - two, [j, k]
        rise = 2 * gain * (fill[high] - fill[low] + gain)
        if gain and rise > best:
            best, found = rise, (high, out)
    return found


def _pack(limit: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row_key", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy(dtype=np.int64)
        bins = improve(best_fit(lengths, limit), lengths, limit)
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = b, at
                at += int(lengths[i])
        group["sequence_id"], group["offset"] = sequence + (group["pack_group"].to_numpy(dtype=np.int64) << 32), offset
        return group[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack_pieces(pieces: DataFrame, limit: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Sequences for ``pieces(doc_id, piece, start, length, ids_crc32, row_key)``; ids stay where they are.

    The number of groups follows from the number of pieces. A group loses at
    most about one underfull sequence, so the loss does not grow with the data.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("row_key", "piece", "start"), F.lit(groups)).cast("int"))
    return dealt.groupBy("pack_group").applyInPandas(
        _pack(limit), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_file: str, pattern: str, limit: int = SEQUENCE_TOKENS) -> tuple[DataFrame, DataFrame]:
    """``(pieces, places)``: the written pieces with their ids, and each piece's place.

    A null text counts as empty and is one piece of one token. Ids may be
    null or repeated; every row is packed. Pieces of equal length come in the
    order in which they meet. A very long text is encoded by one task and cut.
    Other columns are ignored. An empty table gives empty results. ``sequences`` joins the two to whole sequences.
    """
    pieces = settle(token_pieces(docs, tokenizer_file, pattern, limit), "pieces")
    places = pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "row_key"), limit)
    return pieces, places


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (binary) of whole sequences; for documents with distinct ids."""
    parts = pieces.select("doc_id", "piece", "ids").join(places, ["doc_id", "piece"])
    return (parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")))


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
