"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics. The
normal equations are sums over rows, so every partition adds up its own and
only their sum, of a fixed size, is solved. The scores are then calibrated by
pooling adjacent violators over a fixed number of bins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, settle, slices

STATISTICS = ("log_words", "word_length", "upper", "symbols", "marks", "digits", "other", "distinct_words", "repeated_neighbours",
              "line_repeats", "log_line_words", "top_word")
#: Fourier features, kernel width (standardised units), ridge, bins of the calibration, labelled rows at most, seed.
FEATURES, WIDTH, RIDGE, BINS, MAX_LABELLED, SEED = 192, 3.0, 1.0, 1000, 60_000, 7
#: Standardised statistics are cut off here, so that one odd text can't leave the range seen in training.
REACH = 6.0
_SYMBOLS = frozenset("#*$%&|<>~^_=\\{}[]@")


def statistics_of(text: str) -> list[float]:
    """The statistics of a text; an empty one has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = sum(map(len, words))
    seen = Counter(text)
    upper = sum(k for c, k in seen.items() if c.isupper())
    digits = sum(k for c, k in seen.items() if c.isdigit())
    letters = sum(k for c, k in seen.items() if c.isalpha())
    symbols = sum(k for c, k in seen.items() if c in _SYMBOLS)
    marks = sum(seen[c] for c in "!?")
    distinct = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log(n), chars / n, upper / max(1, letters), math.sqrt(symbols / chars), math.sqrt(marks / chars), math.sqrt(digits / chars),
        max(0, chars - letters - symbols - marks - digits) / chars, len(distinct) / n ** 0.9,
        math.sqrt(sum(map(str.__eq__, words, words[1:])) / n), 1 - len(set(lines)) / max(1, len(lines)),
        math.log(n / max(1, len(lines))), max(distinct.values()) / n]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        x = np.array([statistics_of(t or "") for t in part.column("text").to_pylist()])
        keep = [part.column(c) for c in part.schema.names if c != "text"]
        names = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=[*names, *STATISTICS])


_STATS = ", ".join(f"{s} double" for s in STATISTICS)


def projection(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of the Fourier features."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(len(STATISTICS), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Fourier features of rows of statistics, with a constant in front."""
    freq, phase = projection()
    z = np.clip((x - mean) / scale, -REACH, REACH)
    return np.hstack([np.ones((len(x), 1)), math.sqrt(2 / FEATURES) * np.cos(z @ freq + phase)])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(s).to_numpy() for s in STATISTICS], axis=1)


def _normal_equations(mean: np.ndarray, scale: np.ndarray):
    """Partition sums of the normal equations, one row for each of their rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                f = fourier(_matrix(batch), mean, scale)
                total += f.T @ np.hstack([f, batch.column("y").to_numpy()[:, None].astype(float)])
        if total[0, 0]:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())],
                                             names=["i", "j", "v"])

    return run


def _scorer(mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, extra: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = fourier(_matrix(batch), mean, scale) @ weights
                yield pa.RecordBatch.from_arrays([batch.column(extra), pa.array(raw)], names=[extra, "raw"])

    return run


def isotonic(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Non-decreasing means of bins with the given sums and counts: pool adjacent violators."""
    blocks: list[list[float]] = []  # sum, count, bins
    for s, n in zip(total.tolist(), count.tolist(), strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), s / n if n else 0.0) for s, n, k in blocks]) if blocks else np.zeros(0)


def fit(train: DataFrame) -> dict:
    """The model from measured training rows ``(y, statistics)``; everything collected has a fixed size."""
    sums = train.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(s).alias(f"m_{s}") for s in STATISTICS],
                     *[F.stddev_pop(s).alias(f"d_{s}") for s in STATISTICS]).first()
    if not sums["n"]:
        return {"prior": 0.5}
    mean = np.array([sums[f"m_{s}"] for s in STATISTICS])
    scale = np.maximum(np.array([sums[f"d_{s}"] for s in STATISTICS]), 1e-6)
    rows = train.select("y", *STATISTICS).mapInArrow(_normal_equations(mean, scale), "i int, j int, v double") \
        .groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    eq = np.zeros((FEATURES + 1, FEATURES + 2))
    eq[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["v"].to_numpy()
    ridge = RIDGE * np.eye(FEATURES + 1)
    ridge[0, 0] = 1e-9
    weights = np.linalg.solve(eq[:, :-1] + ridge, eq[:, -1])
    raw = train.select(F.col("y").cast("int").alias("y"), *STATISTICS).mapInArrow(_scorer(mean, scale, weights, "y"), "y int, raw double")
    at = F.least(F.greatest(F.floor((F.col("raw") + 0.5) / 2 * BINS), F.lit(0)), F.lit(BINS - 1))
    bins = raw.groupBy(at.cast("int").alias("b")).agg(F.sum("y").alias("s"), F.count("*").alias("n")).toPandas().sort_values("b")
    steps = isotonic(bins["s"].to_numpy(dtype=float), bins["n"].to_numpy(dtype=float))
    return {"mean": mean, "scale": scale, "weights": weights, "bins": bins["b"].to_numpy(dtype=float), "steps": steps, "prior": float(sums["y"])}


def calibrate(model: dict, raw: np.ndarray) -> np.ndarray:
    """Calibrated scores; between bins they are interpolated, and a small slope keeps the order of raw scores."""
    centre = (model["bins"] + 0.5) / BINS * 2 - 0.5
    step = np.interp(raw, centre, model["steps"])
    return np.clip(0.98 * step + 0.02 / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def _grade(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for part in slices(batches):
            if "weights" in m:
                x = np.array([statistics_of(t or "") for t in part.column("text").to_pylist()])
                score = calibrate(m, fourier(x, m["mean"], m["scale"]) @ m["weights"])
            else:
                score = np.full(part.num_rows, m["prior"])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Labels are learnt from ``labels(doc_id, quality)`` for ids whose crc32
    modulo 5 is not 0, from ``max_labelled`` documents at most. Null and empty
    texts have statistics of zero and are scored like any other. Null ids are
    scored and not held out; repeated rows score alike, as do texts of
    equal statistics; a very long text is one task's work; other columns are
    ignored; an empty table gives an empty result, and without any label every score is 0.5.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = labelled(docs, labels, "quality", max_labelled).select("text", F.col("y").cast("int").alias("y"))
    measured = settle(train.mapInArrow(_measure, f"y int, {_STATS}"), "quality_training")
    model = docs.sparkSession.sparkContext.broadcast(fit(measured))
    out = docs.mapInArrow(_grade(model), "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
