"""MinHash near-dedup with SuperMinHash signatures (Ertl 2017).

Every shingle draws a random permutation of the signature's slots and writes
``rank + fraction`` into the slot of each rank, rank by rank; a slot keeps its
minimum. Slots are therefore filled with correlated values whose agreement
estimates the Jaccard similarity with a lower variance than independent
minima. Ranks are drawn for all shingles of a batch of documents at once, and
a document stops as soon as all its slots hold a value below the next rank.

Signatures are cut into bands; documents that share a band are candidates.
Inside a band bucket candidates are compared with one hub, not all with all;
only pairs that lie in one bucket but still in different groups afterwards
are compared pair by pair, so that no link is lost. Links are confirmed on
the full shingle sets of the texts, and grouped by contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, blocked, blocks, mix64, settle, slices
from .graph import components

SHINGLE_WORDS = 5
SLOTS = 128
BAND_ROWS = 4
#: Share of equal slots below which a pair can't have the wanted similarity:
#: the threshold less 4.5 standard deviations of the estimate.
SIGMAS = 4.5
#: Hub rounds before the remaining pairs are compared one by one.
HUB_ROUNDS = 2
#: Rows of a bucket that one block holds; larger buckets are compared block against block.
BLOCK_ROWS = 512
#: Shingles of a block, as far as its rows are not longer by themselves.
BLOCK_SHINGLES = 4_000_000
#: Characters whose shingles are signed at once: a shingle's shuffle takes a byte per slot, twice while documents leave.
SIGN_CHARS = 250_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)

SIGNATURE_SCHEMA = "doc_id long, text_hash long, n_shingles long, set_hash long, bands array<long>, signature binary"


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space of the text, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: list[bytes], k: int = SHINGLE_WORDS) -> set[tuple[bytes, ...]]:
    """Distinct ``k``-word shingles; a shorter text is one shingle, an empty one none."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def shingle_hashes(texts: list[str | None], k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    words = [words_of(t) if t else [] for t in texts]
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()), dtype=np.uint64, count=len(flat.dictionary))
    hashed = table[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    odd = mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        h, at = hashed[at:at + n], at + n
        width = min(n, k)
        x = np.full(n - width + 1 if n else 0, width, np.uint64)
        for j in range(width):
            x = mix64(x * odd[j] + h[j:n - width + 1 + j])
        out.append(np.unique(x))
    return out


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures, a row of ``slots`` floats for each set; empty sets get infinity.

    The state of an element's Fisher-Yates shuffle is only kept from its
    second rank on, for the documents that need one.
    """
    sizes = np.array([len(s) for s in sets])
    best = np.full(len(sets) * slots, np.inf)
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    perm = None
    for rank in range(slots):
        if not len(x):
            break
        r = mix64(x + np.uint64((rank + 1) * int(_GOLD) % 2**64))
        pick = rank + ((r & np.uint64(0xFFFFFF)) * np.uint64(slots - rank) >> np.uint64(24)).astype(np.int64)
        value = rank + (r >> np.uint64(24)).astype(np.float64) / 2.0**40
        if perm is None:
            slot = pick
        else:
            rows = np.arange(len(x))
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[rows, rank]
        np.minimum.at(best, doc * slots + slot, value)
        more = (best.reshape(-1, slots).max(axis=1) >= rank + 1)[doc]
        if perm is None:
            x, doc, first = x[more], doc[more], pick[more]
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(x), 1))
            perm[np.arange(len(x)), first] = 0
        elif not more.all():
            x, doc, perm = x[more], doc[more], perm[more]
    return best.reshape(-1, slots)


def band_hashes(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit hash for each band of ``rows`` slots."""
    bits = signatures.view(np.uint64).reshape(len(signatures), -1, rows)
    h = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2]).copy()
    for j in range(rows):
        h = mix64(h * _GOLD + bits[:, :, j] + np.uint64(1))
    return h


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])
    for part in slices(batches, most=SIGN_CHARS):
        sets = shingle_hashes(part.column("text").to_pylist())
        sig = superminhash(sets)
        bands = band_hashes(sig).view(np.int64)
        short = (mix64(sig.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        with np.errstate(over="ignore"):
            total = np.array([int(mix64(s).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64)
            key = mix64(total + np.array([len(s) for s in sets], dtype=np.uint64) * _GOLD).view(np.int64)
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key),
            pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands.shape[1], bands.ravel()),
            pa.array([x.tobytes() for x in short], pa.binary())], schema=schema)


def signatures(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``, as ``SIGNATURE_SCHEMA``."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_sign, SIGNATURE_SCHEMA)


def variance_factor(slots: int = SLOTS, most: int = 4096) -> np.ndarray:
    """By the size of the union: the estimate's variance as a share of that of independent minima (Ertl 2017, theorem 1)."""
    step = np.arange(1, slots) / slots
    out = np.ones(most + 1)
    for u in range(2, most + 1):
        part = (np.arange(1, slots) / (slots - 1)) ** u * ((step + 1 / slots) ** u + (step - 1 / slots) ** u - 2 * step ** u)
        out[u] = 1 - (slots - 1) / (u - 1) * part.sum()
    out[1] = out[2]
    return out


def _least_share(threshold: float, factor: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Equal slots that pairs of sets with ``na`` and ``nb`` elements have, if they have the wanted similarity."""
    union = np.ceil((na + nb) / (1 + threshold)).astype(np.int64)  # of a pair at the threshold; it is no larger beyond
    alpha = np.where(union < len(factor), factor[np.minimum(union, len(factor) - 1)], 1.0)
    return threshold - SIGMAS * np.sqrt(alpha * threshold * (1 - threshold) / SLOTS)


def _alike(threshold: float):
    factor = variance_factor()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            keep = np.minimum(na, nb) >= threshold * np.maximum(na, nb)
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in ("sa", "sb"))
            keep &= (sa == sb).mean(axis=1) >= _least_share(threshold, factor, na, nb)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirm(threshold: float):
    want = Fraction(str(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple[int | None, set]] = {"a": (None, set()), "b": (None, set())}
        for batch in batches:
            for part in slices([batch], "ta"):
                keep = []
                for a, b, ta, tb in zip(*(part.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                    for side, key, text in (("a", a, ta), ("b", b, tb)):
                        if last[side][0] != key:
                            last[side] = (key, shingles_of(words_of(text)))
                    sa, sb = last["a"][1], last["b"][1]
                    both = len(sa & sb)
                    keep.append(both * want.denominator >= want.numerator * (len(sa) + len(sb) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns
    ``doc_id, n_shingles, component_id, kept``, a row for each row. Rows with
    equal sets are one class and are never expanded into pairs. A null text
    counts as empty; rows without words or without a doc_id link with
    nothing and are kept (component_id is then their own id, or null).
    Repeated rows of one doc_id get the same answer, and of a group whose
    smallest id is repeated all those rows are kept. Ties between ids do not
    arise otherwise, as the smallest one counts. A very long text is signed in
    one task, in proportion to its length. An empty table gives an empty result.

    By design a pair at the threshold is missed with a probability of about
    1.2e-5: no shared band (5e-6) or a signature 4.5 deviations too low (7e-6).
    """
    signed = settle(signatures(docs), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = settle(usable.groupBy("set_hash").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")
    banded = classes.select("set_hash", F.explode("bands").alias("band"))
    links = _links(docs, classes, banded, threshold)
    label = components(links)
    groups = classes.select("set_hash", "rep.doc_id").join(label.withColumnRenamed("id", "set_hash"), "set_hash", "left") \
        .select("set_hash", "doc_id", F.coalesce("label", "set_hash").alias("label"))
    groups = settle(groups, "groups")
    least = settle(groups.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    of = settle(groups.join(least, "label").select("set_hash", "component_id"), "component_of")
    linked = usable.select("doc_id", "n_shingles", "set_hash").join(of, "set_hash").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(docs: DataFrame, classes: DataFrame, banded: DataFrame, threshold: float) -> DataFrame:
    """Confirmed links ``(a, b)`` between classes: enough of them to connect all that are linked."""
    # buckets with two classes or more; the written table lets Spark split a hot bucket in the joins below
    live = settle(banded.join(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "band", "left_semi")
                  .select("band", "set_hash", F.col("set_hash").alias("label")), "buckets")
    wanted = live.select("set_hash").distinct().join(classes, "set_hash").select("set_hash", "rep.doc_id", "rep.text_hash")
    texts = settle(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(wanted, ["doc_id", "text_hash"])
                   .select("set_hash", "text").dropDuplicates(["set_hash"]), "candidate_texts")
    links = None
    for turn in range(HUB_ROUNDS + 1):
        if turn < HUB_ROUNDS:
            # a hub drawn for each bucket and round: members of a group meet as many hubs as they share buckets
            draw = F.xxhash64("set_hash", "band", F.lit(turn))
            hubs = settle(live.groupBy("band").agg(F.min(F.struct(draw.alias("draw"), "label", "set_hash")).alias("hub"))
                          .select("band", F.col("hub.label").alias("hub_label"), F.col("hub.set_hash").alias("hub")), "hubs")
            pairs = live.join(hubs, "band").where("label <> hub_label").select(F.least("hub", "set_hash").alias("a"), F.greatest("hub", "set_hash").alias("b"))
        else:
            pairs = _across(live, classes, texts, threshold)
        found = settle(_check(pairs.distinct(), classes, texts, threshold), "links")
        links = found if links is None else links.unionByName(found)
        if turn == HUB_ROUNDS:
            break
        label = components(links)
        moved = live.select("band", "set_hash").join(label.withColumnRenamed("id", "set_hash"), "set_hash", "left") \
            .select("band", "set_hash", F.coalesce("label", "set_hash").alias("label"))
        moved = settle(moved, "relabelled")
        open_ = settle(moved.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band"), "open")
        live = settle(moved.join(open_, "band"), "buckets")
    return links


def _shingle_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, most=SIGN_CHARS):
        lists = [np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in shingle_hashes(part.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([part.column("set_hash"), pa.array(lists, pa.binary())], names=["set_hash", "shingles"])


def _across(live: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes that share a bucket but not a group and are alike.

    Compared in blocks of bounded size, first by their signatures, then by
    short hashes of all their shingles, so that of a bucket of many texts that
    share a passage and stay below the threshold hardly any pair leaves its
    task. A pair that shares several buckets is sent on from the first; all of
    them hold both groups, so it is there.
    """
    sides = classes.select("set_hash", "n", "signature", "bands")
    lists = settle(texts.join(live.select("set_hash").distinct(), "set_hash").select("set_hash", "text")
                   .mapInArrow(_shingle_lists, "set_hash long, shingles binary"), "shingle_lists")
    rows = live.select("band", "set_hash", "label").join(sides, "set_hash").join(lists, "set_hash")
    return blocked(rows, ["band"], "set_hash", BLOCK_ROWS, "n", BLOCK_SHINGLES).mapInArrow(_alike_in_block(threshold), "a long, b long")


def _common(i: np.ndarray, j: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Equal hashes of each pair of lists, all partners of a list at once; ``i`` ascends."""
    out = np.zeros(len(i), np.int64)
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(i)], strict=True):
        own = lists[i[s]]
        for k in range(s, e, 512):
            others = [lists[x] for x in j[k:min(k + 512, e)]]
            flat = np.concatenate(others)
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            out[k:min(k + 512, e)] = np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)
    return out


def _alike_in_block(threshold: float):
    factor = variance_factor()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, ["band"]):
            n, label, sub, key = (part.column(c).to_numpy() for c in ("n", "label", "sub", "set_hash"))
            sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(part.num_rows, -1)
            bi, bj = part.column("bi")[0].as_py(), part.column("bj")[0].as_py()
            left, right = np.flatnonzero(sub == bi), np.flatnonzero(sub == bj)
            a, b = n[left][:, None], n[right][None]
            near = (label[left][:, None] != label[right][None]) & (np.minimum(a, b) >= threshold * np.maximum(a, b))
            i, j = block_pairs(near, left, right, bi == bj)
            keep = np.concatenate([(sig[i[s:s + 8192]] == sig[j[s:s + 8192]]).mean(axis=1) >= _least_share(threshold, factor, n[i[s:s + 8192]], n[j[s:s + 8192]])
                                   for s in range(0, len(i), 8192)] or [[]])
            i, j = i[keep.astype(bool)], j[keep.astype(bool)]
            if len(i):  # a pair counts in the first band that its two share
                bands = np.array(part.column("bands").to_pylist(), dtype=np.int64)
                first = (bands[i] == bands[j]).argmax(axis=1)
                new = bands[i, first] == part.column("band")[0].as_py()
                i, j = i[new], j[new]
            if len(i):
                lists = [np.frombuffer(x, np.uint32) for x in part.column("shingles").to_pylist()]
                sizes = np.array([len(x) for x in lists])
                # shingles of a set that fall on one hash may all be shared, though they count once
                both = _common(i, j, lists) + np.minimum(n[i] - sizes[i], n[j] - sizes[j])
                new = both >= threshold * (n[i] + n[j] - both) - 1e-6
                i, j = i[new], j[new]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[i], key[j])), pa.array(np.maximum(key[i], key[j]))], names=["a", "b"])

    return run


def _check(pairs: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose texts have the wanted similarity: first by signature and set size, then on the full sets."""
    def side(c: str) -> DataFrame:
        return classes.select(F.col("set_hash").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))

    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_alike(threshold), "a long, b long")
    near = settle(near, "near")
    ta, tb = (texts.select(F.col("set_hash").alias(c), F.col("text").alias(f"t{c}")) for c in ("a", "b"))
    return near.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_confirm(threshold), "a long, b long")
