"""Toxicity scores of texts restored through a noisy channel.

A token that may be disguised (look-alike characters, letters drawn out or
doubled, spaced apart or with marks between them) becomes a lattice of the letters it may stand for. The Viterbi
path under a character trigram model, counted over all documents, restores
it. Words and word beginnings of restored texts get the share of toxic
documents among the training documents that hold them, and a logistic model
turns a document's strongest evidence into its score.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, settle, slices

#: What a character may stand for besides itself.
LOOK_ALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou", "€": "e",
}
#: Costs of the channel, in natural logs: a look-alike, a dropped mark, letters of a run left out, a closed gap.
SWAP, DROP, SQUEEZE, GAP = 1.0, 3.0, 0.5, 0.2
#: Letters of the model: 0 a word's end, 1-26 a-z without accents, 27 any other letter.
LETTERS = 28
#: Buckets of hashed terms, labelled documents at most, weight of the prior share.
TERMS, MAX_LABELLED, PRIOR = 1 << 20, 60_000, 6.0
#: Terms whose share can't raise a score are not kept.
LEAST_SHARE = 0.15
#: Disguised tokens longer than this are words joined, looked at from each letter and not remembered.
LONGEST, REMEMBERED = 40, 400_000
#: Words (by hash) counted less often are unknown; a doubled letter is squeezed into a word this many times as frequent.
KNOWN, DOUBLED_PLACES = 4, 6
PREFIXES = (4, 5, 6, 8)
#: Letters of what is read from a letter inside a run; more than the longest word beginning.
PIECE = 24
FEATURES = 4
NEWTON_STEPS, RIDGE = 10, 1.0

_EDGE = re.compile(r"^[^\w$@*!|+(€]+|[^\w$@]+$")
_ODD = re.compile(r"[0-9@$!|+(*#%€]|([^\W\d_])\1\1")
_MARKED = re.compile(r"([^\W\d_])([\W_]+)(?=[^\W\d_])")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_SHORT_RUN = re.compile(r"(?<!\S)\S{1,2}\s+\S{1,2}\s+\S{1,2}(?!\S)")
_LETTER = re.compile(r"[^\W\d_]")


def fold(c: str) -> int:
    """Letter number of a character for the model."""
    b = unicodedata.normalize("NFD", c)[0]
    return ord(b) - 96 if "a" <= b <= "z" else LETTERS - 1


class Restorer:
    """Viterbi decoding of character lattices under a trigram model, given as costs ``[a, b, c]``.

    ``words`` are the counts of plain words by ``word_bucket``, if known.
    """

    def __init__(self, costs: np.ndarray, words: np.ndarray | None = None):
        self.words = words
        self.costs = costs.tolist()
        # the last two letters change the cost of what follows by at most this
        self.spread = 2 * float(costs.max()) + 1e-6
        self.folded: dict[str, int] = {}

    def _fold(self, c: str) -> int:
        if c not in self.folded:
            if len(self.folded) > 5000:
                self.folded.clear()
            self.folded[c] = fold(c)
        return self.folded[c]

    def arcs(self, chars: str) -> list[list[tuple[int, str, float]]]:
        """For each place the arcs ``(next place, what is read, cost)``. A blank may be closed."""
        out: list[list[tuple[int, str, float]]] = []
        ends = list(range(1, len(chars) + 1))
        for i in range(len(chars) - 2, -1, -1):
            if chars[i] == chars[i + 1]:
                ends[i] = ends[i + 1]
        for i, c in enumerate(chars):
            here: list[tuple[int, str, float]] = []
            end = ends[i]
            if c == " ":
                here += [(i + 1, " ", 0.0), (i + 1, "", GAP)]
            elif _LETTER.match(c):
                here.append((i + 1, c, 0.0))
                if end - i > 1:
                    here.append((end, c, SQUEEZE))
            else:
                for x in LOOK_ALIKES.get(c, ""):
                    here.append((i + 1, x, SWAP))
                    if end - i > 1:
                        here.append((end, x, SWAP + SQUEEZE))
                here.append((end, "", DROP))
            out.append(here)
        return out

    def restore(self, chars: str) -> str:
        """The cheapest reading of ``chars``, of any length; of equal ones the first in order.

        What all open readings begin with is put aside now and then, and
        readings that no continuation can make the cheapest are dropped, so
        the work grows with the length. Neither changes the result.
        """
        costs = self.costs
        states: dict[int, dict[tuple[int, int], tuple[float, str]]] = {0: {(0, 0): (0.0, "")}}
        agreed = []
        for i, here in enumerate(self.arcs(chars)):
            now = states.pop(i, None)
            if now is None:
                continue
            # every way on from here leads through the furthest end
            meet = max(end for end, _, _ in here)
            least = min(now.values())[0]
            if meet in states:
                least = min(least, min(states[meet].values())[0])
            least += self.spread
            for (a, b), (cost, read) in now.items():
                if cost > least:
                    continue
                for end, c, price in here:
                    if not c:
                        key, total, text = (a, b), cost + price, read
                    elif c == " ":
                        key, total, text = (0, 0), cost + price + costs[a][b][0], read + c
                    else:
                        x = self._fold(c)
                        key, total, text = (b, x), cost + price + costs[a][b][x], read + c
                    there = states.setdefault(end, {})
                    old = there.get(key)
                    if old is None or (total, text) < old:
                        there[key] = (total, text)
            if i % 64 == 63:
                n = len(start := os.path.commonprefix([read for there in states.values() for _, read in there.values()]))
                agreed.append(start)
                states = {end: {key: (cost, read[n:]) for key, (cost, read) in there.items()} for end, there in states.items()}
        rest = min((cost + costs[a][b][0], read) for (a, b), (cost, read) in states[len(chars)].items())[1]
        return "".join(agreed) + rest

    def word(self, token: str) -> str:
        """A token without its outer marks, restored if it may be disguised."""
        token = _EDGE.sub("", token)
        if not token or not _LETTER.search(token):
            return ""
        return self.restore(token) if _ODD.search(token) else token

    def readings(self, token: str) -> tuple[str, ...]:
        """The words that a token may hold.

        Marks between letters and doubled letters also stand in honest words,
        so there the token as written is kept beside what the lattice reads.
        """
        token = _EDGE.sub("", token)
        if not token or not _LETTER.search(token):
            return ()
        if _ODD.search(token):
            written, read = (), self.restore(token)
        elif is_marked(token):
            written, read = (token,), self.restore(token)
        else:
            read = self.undoubled(token)
            return (token, read) if read else (token,)
        return (*written, read, *(run_words(read) if len(token) > LONGEST else ()))

    def undoubled(self, token: str) -> str:
        """The most frequent word that a plain token is with letters doubled, or nothing if the token is known well enough itself.

        All ways to squeeze are tried with up to ``DOUBLED_PLACES`` doubled
        letters; with more, the lattice's reading alone.
        """
        if self.words is None or not _DOUBLED.search(token):
            return ""
        places = [m.start() for m in _DOUBLED.finditer(token)]
        # the lattice of a word of letters alone holds no other readings than these
        maybe = [] if len(places) <= DOUBLED_PLACES and token.isalpha() else [self.restore(token)]
        if len(places) <= DOUBLED_PLACES:
            for k in range(1, len(places) + 1):
                for out in combinations(places, k):
                    maybe.append("".join(c for i, c in enumerate(token) if i not in out))
        n, word = max((int(self.words[word_bucket(w)]), w) for w in maybe if w != token) if maybe != [token] else (0, "")
        return word if n >= KNOWN * max(1, int(self.words[word_bucket(token)])) else ""


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % TERMS


def is_marked(token: str) -> bool:
    """Whether marks stand between letters. Combining marks count after a-z only, as other scripts spell with them."""
    return any(fold(m[1]) < LETTERS - 1 or any(unicodedata.category(c)[0] != "M" for c in m[2]) for m in _MARKED.finditer(token))


def split_tokens(text: str) -> tuple[list[str], list[str]]:
    """Tokens of a text in lower case, and its runs of three or more tokens of one letter."""
    text = text.lower()
    tokens = text.split()
    runs, run = [], []
    if not _SHORT_RUN.search(text):
        return tokens, runs
    for t in tokens:
        if len(t) <= 2 and len(b := _EDGE.sub("", t) if len(t) == 2 else t) == 1 and (b.isalnum() or b in LOOK_ALIKES):
            run.append(b)
            continue
        if len(run) >= 3:
            runs.append(" ".join(run))
        run = []
    if len(run) >= 3:
        runs.append(" ".join(run))
    return tokens, runs


def term_ids(word: str) -> list[int]:
    """Hashed terms of a word: itself and its beginnings of some lengths, in bytes."""
    raw = word.encode("utf-8", "surrogatepass")
    if len(raw) < 3:
        return []
    out, at, crc = [zlib.crc32(raw, 1) % TERMS], 0, 2
    for n in PREFIXES:
        if n > len(raw):
            break
        crc = zlib.crc32(raw[at:n], crc)
        out.append(crc % TERMS)
        at = n
    return out


def run_words(restored: str) -> list[str]:
    """Words that a restored run of single letters may hold: its parts, and what starts at each letter of a closed part.

    Every letter of a run of any length is a start. What starts inside a part
    is read for ``PIECE`` letters, which hold all word beginnings of
    ``term_ids``; only whole words of more letters are known by their
    beginnings alone there.
    """
    return [w for part in restored.split() if len(part) >= 3 for w in (part, *(part[i:i + PIECE] for i in range(1, len(part) - 2)))]


def _letters_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, held = np.zeros(LETTERS**3), np.zeros(TERMS, np.int64)
    known: dict[str, int] = {}
    for part in slices(batches):
        words = Counter(w for t in part.column("text").to_pylist() if t for w in t.lower().split())
        plain = {w: n for w, n in words.items() if w.isalpha()}
        if not plain:
            continue
        chars = "".join(f"\0\0{w}\0" for w in plain)
        points = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, where = np.unique(points, return_inverse=True)
        code = np.array([0 if not c else known.setdefault(chr(c), fold(chr(c))) for c in distinct.tolist()])[where]
        sizes = np.array([len(w) + 3 for w in plain])
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(sizes)), sizes)
        weight = np.fromiter(plain.values(), float, len(plain))[word]
        np.add.at(held, np.fromiter(map(word_bucket, plain), np.int64, len(plain)), np.fromiter(plain.values(), np.int64, len(plain)))
        at = np.arange(len(code)) - first[word]
        use = np.flatnonzero(at >= 2)
        counts += np.bincount((code[use - 2] * LETTERS + code[use - 1]) * LETTERS + code[use], weights=weight[use], minlength=LETTERS**3)
        if len(known) > 20_000:
            known = {}
    hit = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(counts[hit].astype(np.int64))], names=["code", "n"])
    # words by hash follow the letters
    hit = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(hit + LETTERS**3, pa.int64()), pa.array(held[hit], pa.int64())], names=["code", "n"])


def letter_model(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Costs of the trigram model and counts of known words by hash, counted over all texts.

    At most ``LETTERS**3 + TERMS`` counts reach the driver.
    """
    rows = (docs.select("text").mapInArrow(_letters_counter, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
            .where(f"code < {LETTERS**3} or n >= {KNOWN}")).toArrow()
    counts = np.zeros(LETTERS**3 + TERMS)
    counts[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    words = counts[LETTERS**3:].astype(np.int64)
    tri = counts[:LETTERS**3].reshape(LETTERS, LETTERS, LETTERS)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + LETTERS)
    p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
    p3 = (tri + 20 * p2) / (tri.sum(axis=2, keepdims=True) + 20)
    return -np.log(p3), words


def _slice_words(part: pa.RecordBatch, restorer: Restorer, known: dict) -> Iterator[set]:
    """For each text of a slice the set of its distinct restored words."""
    for text in part.column("text").to_pylist():
        if len(known) > REMEMBERED:
            known.clear()
        tokens, runs = split_tokens(text or "")
        out = set()
        for t in set(tokens):
            w = known.get(t)
            if w is None:
                w = restorer.readings(t)
                if len(t) <= LONGEST:
                    known[t] = w
            out.update(w)
        for r in runs:
            out.update(run_words(restorer.restore(r)))
        out.discard("")
        yield out


def _restored(model):
    """The distinct restored words of each text, one a line (no word holds white space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, known = Restorer(*model.value), {}
        schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("words", pa.string())])
        for part in slices(batches):
            words = pa.array(["\n".join(w) for w in _slice_words(part, restorer, known)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), words], schema=schema)

    return run


def _written_words(part: pa.RecordBatch) -> Iterator[set]:
    """The word sets that ``_restored`` wrote."""
    for words in part.column("words").to_pylist():
        yield set(words.split("\n")) if words else set()


def _term_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: dict = {}
    toxic, held = np.zeros(TERMS, np.int32), np.zeros(TERMS, np.int32)
    for part in slices(batches, "words"):
        for words, y in zip(_written_words(part), part.column("y").to_pylist(), strict=True):
            if len(ids) > REMEMBERED:
                ids.clear()
            terms = set()
            for w in words:
                t = ids.get(w)
                if t is None:
                    t = ids[w] = term_ids(w)
                terms.update(t)
            at = np.fromiter(terms, np.int64, len(terms))
            held[at] += 1
            toxic[at] += y
    hit = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(toxic[hit], pa.int64()), pa.array(held[hit], pa.int64())],
                                     names=["term", "toxic", "held"])


def _evidence(model, table, column: str):
    """Features of each row, from its ``text`` or its written ``words``.

    A training row (``y`` not null) is left out of the shares it is judged by.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, known = Restorer(*model.value), {}
        shares: dict = {None: {}, 0: {}, 1: {}}  # of words, by the label that is left out
        evidence, base = table.value
        schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), *((f"x{i}", pa.float64()) for i in range(FEATURES))])

        def best(word: str, y: int | None) -> float:
            top = base
            for t in term_ids(word):
                if t in evidence:
                    toxic, held = evidence[t]
                    if y is not None:
                        toxic, held = max(toxic - y, 0), held - 1
                    top = max(top, (toxic + PRIOR * base) / (held + PRIOR))
            return top

        for part in slices(batches, column):
            rows = []
            found = _written_words(part) if column == "words" else _slice_words(part, restorer, known)
            for words, y in zip(found, part.column("y").to_pylist(), strict=True):
                mine = shares[y]
                if len(mine) > REMEMBERED:
                    mine.clear()
                for w in (w for w in words if w not in mine):
                    mine[w] = best(w, y)
                got = sorted((s for s in map(mine.__getitem__, words) if s > base), reverse=True)
                one, two = (got + [base, base])[:2]
                rows.append((math.log(one / (1 - one)), math.log(two / (1 - two)), math.log1p(sum(s > 0.6 for s in got)), math.log1p(len(words))))
            x = np.array(rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *(pa.array(x[:, i]) for i in range(FEATURES))], schema=schema)

    return run


_EVIDENCE_SCHEMA = "doc_id long, y int, " + ", ".join(f"x{i} double" for i in range(FEATURES))


def fit_logistic(rows: DataFrame, features: list[str], prior: float) -> np.ndarray:
    """Weights (intercept first) by Newton steps; every step sums gradient and curvature over the partitions."""
    names = ["1.0D", *features]
    w = np.zeros(len(names))
    w[0] = math.log(prior / (1 - prior))
    for _ in range(NEWTON_STEPS):
        z = " + ".join(f"({float(a)!r}D) * {n}" for a, n in zip(w, names, strict=True))
        p = f"(1 / (1 + exp(-({z}))))"
        grad = [f"sum((y - p) * {n})" for n in names]
        curve = [f"sum(p * (1 - p) * {a} * {b})" for i, a in enumerate(names) for b in names[i:]]
        got = rows.withColumn("p", F.expr(p)).agg(*[F.expr(e).alias(f"s{i}") for i, e in enumerate(grad + curve)]).first()
        if got[0] is None:
            break
        k = len(names)
        g = np.array(got[:k]) - RIDGE * np.r_[0, w[1:]]
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = got[k:]
        h = h + np.triu(h, 1).T + RIDGE * np.eye(k)
        step = np.linalg.solve(h, g)
        w = w + step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-6:
            break
    return w


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Labels are learnt from ``labels(doc_id, toxic)`` for ids whose crc32 modulo
    5 is not 0, from ``max_labelled`` documents at most; the letter model
    counts all texts. Null and empty texts get the score of a text without
    evidence. Null ids are scored and not held out; repeated rows score
    alike; of words equally frequent with and without a doubled letter the one
    as written is kept; a very long text is one task's work, token by token;
    other columns are ignored; empty tables give an empty result, and without any
    label every score is the prior, 0.01.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(letter_model(docs))
    train = labelled(docs, labels, "toxic", max_labelled).select("doc_id", "text", F.col("y").cast("int").alias("y"))
    # every text is restored once: what the training rows hold is written, and read for counts, fit and scores
    words = settle(train.mapInArrow(_restored(model), "doc_id long, y int, words string"), "training_words")
    base_row = words.agg(F.avg("y").alias("p")).first()
    base = min(max(base_row["p"] or 0.01, 0.001), 0.9)
    counts = (words.select("words", "y").mapInArrow(_term_counter, "term long, toxic long, held long")
              .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("held").alias("held"))
              .where(f"held >= 2 and (toxic + {PRIOR * base}) / (held + {PRIOR}) >= {LEAST_SHARE}")).toPandas()
    # at most TERMS entries, whatever the number of documents
    evidence = {t: (x, n) for t, x, n in zip(*(counts[c].tolist() for c in ("term", "toxic", "held")), strict=True)}
    table = spark.sparkContext.broadcast((evidence, base))
    xs = [f"x{i}" for i in range(FEATURES)]
    trained = settle(words.mapInArrow(_evidence(model, table, "words"), _EVIDENCE_SCHEMA), "toxicity_training")
    w = fit_logistic(trained, xs, base)
    z = F.lit(float(w[0]))
    for a, x in zip(w[1:], xs, strict=True):
        z = z + F.lit(float(a)) * F.col(x)
    # training ids are at most about max_labelled; an id's rows are all training rows or none
    unlabelled = F.lit(None).cast("int").alias("y")
    others = docs.join(F.broadcast(words.select("doc_id").distinct()), "doc_id", "left_anti").select("doc_id", "text", unlabelled)
    rows = (others.mapInArrow(_evidence(model, table, "text"), _EVIDENCE_SCHEMA)
            .unionAll(words.select("doc_id", "words", unlabelled).mapInArrow(_evidence(model, table, "words"), _EVIDENCE_SCHEMA)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = rows.select("doc_id", held_out.alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
