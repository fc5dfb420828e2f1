"""Embedding near-dedup by binary codes of randomly rotated vectors.

A vector's code is the signs of its coordinates after a random rotation; with
it goes the code's own inner product with the vector. From a code and another
vector their inner product is estimated without bias, and the spread of the
estimate is known: pairs whose upper confidence bound lies below the threshold
are dropped, all others are recomputed exactly in double precision.

Which vectors meet at all follows from further random rotations: in each of
several tables a vector's cell is given by its largest rotated coordinates.
Cells are compared in blocks of bounded size; a pair counts in the first table
that brings it together. Links leave a task as counts and as a spanning
forest, never as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, blocked, blocks, settle
from .graph import components

THRESHOLD = 0.95
SEED = 11
#: Rows of a cell that one block holds; larger cells are compared block against block.
BLOCK_ROWS = 512
#: Vectors that a cell should hold on average, and dimensions in which cells are taken.
CELL_ROWS, CELL_DIMS = 64, 64
#: Chance that two vectors at the threshold (0.95) share a cell of one rotation, measured in 64 dimensions,
#: and the chance that is allowed to miss such a pair in all tables.
SAME_CELL, MISS = 0.596, 0.004
#: Standard deviations of the estimate that its bounds allow for.
SIGMAS = 6.0
CELL_KEYS = ["dims", "table", "cell"]


def tables_for(rows: int) -> tuple[int, int]:
    """``(rotations in a cell's key, tables)`` for so many vectors: cells stay small, and the chance of a miss fixed."""
    k = max(1, math.ceil(math.log(max(2, rows / CELL_ROWS)) / math.log(2 * CELL_DIMS)))
    return k, math.ceil(math.log(MISS) / math.log(1 - SAME_CELL**k))


def rotation(dims: int, number: int, out: int | None = None, seed: int = SEED) -> np.ndarray:
    """Random orthonormal directions, ``dims`` x ``out``; number 0 is the codes'."""
    rng = np.random.default_rng((seed, dims, number))
    return np.linalg.qr(rng.normal(size=(dims, out or dims)))[0]


def cells(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Cell of each unit vector in each table: the largest rotated coordinate and its sign, for ``k`` rotations."""
    n, dims = unit.shape
    width = min(dims, CELL_DIMS)
    out = np.zeros((n, tables), np.int64)
    for t in range(tables):
        for j in range(k):
            turned = unit @ rotation(dims, 1 + t * k + j, width)
            top = np.abs(turned).argmax(axis=1)
            out[:, t] = out[:, t] * (2 * CELL_DIMS) + 2 * top + (turned[np.arange(n), top] > 0)
    return out


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes (packed bits) and the inner product of each vector with its code's direction."""
    turned = unit @ rotation(unit.shape[1], 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def estimate(codes: np.ndarray, factor: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors (rows) with unit vectors (columns)."""
    dims = unit.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dims).astype(np.float64) * 2 - 1
    return (signs / math.sqrt(dims)) @ (unit @ rotation(dims, 0)).T / factor[:, None]


def slack(factor: np.ndarray, dims: int, threshold: float) -> np.ndarray:
    """How far an estimate may lie below the truth, if that is the threshold, at ``SIGMAS`` deviations."""
    spread = np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(max(1, dims - 1))
    return SIGMAS * spread * math.sqrt(1 - threshold**2)


def _unit(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    return np.array(batch.column("embedding").take(pa.array(at)).to_pylist(), dtype=np.float64)


def _coder(k: int, tables: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cid", pa.int64()), ("copies", pa.int64()), ("embedding", pa.list_(kind)), ("cells", pa.list_(pa.int64())),
                            ("code", pa.binary()), ("factor", pa.float64())])
        for batch in batches:
            size = np.asarray(pa.compute.list_value_length(batch.column("embedding")))
            for dims in np.unique(size):
                at = np.flatnonzero(size == dims)
                x = _unit(batch, at)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                c = np.hstack([cells(unit, k, tables)])
                code, factor = encode(unit)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    batch.column("cid").take(rows), batch.column("copies").take(rows),
                    batch.column("embedding").take(rows).cast(pa.list_(kind)),
                    pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * tables, c.ravel()),
                    pa.array([r.tobytes() for r in code], pa.binary()), pa.array(factor)], schema=schema)

    return run


def _compare_block(rows: dict, threshold: float) -> list[tuple[int, int, int]]:
    """``(cid, links, root)`` for the rows of a block that have links in it."""
    x, t = rows["x"], rows["table"]
    left, right = (np.flatnonzero(rows["sub"] == s) for s in (rows["bi"], rows["bj"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = estimate(rows["code"][left], rows["factor"][left], unit[right]) >= threshold - slack(rows["factor"][left], x.shape[1], threshold)[:, None]
    i, j = block_pairs(near, left, right, rows["bi"] == rows["bj"])
    if not len(i):
        return []
    if t:
        c = rows["cells"][:, :t]
        new = np.concatenate([~(c[i[s:s + 65536]] == c[j[s:s + 65536]]).any(axis=1) for s in range(0, len(i), 65536)])
        i, j = i[new], j[new]
    norm = np.linalg.norm(x, axis=1)
    linked = [np.einsum("ij,ij->i", x[i[s:s + 16384]], x[j[s:s + 16384]]) / (norm[i[s:s + 16384]] * norm[j[s:s + 16384]]) >= threshold
              for s in range(0, len(i), 16384)]
    linked = np.concatenate(linked) if linked else np.zeros(0, bool)
    i, j = i[linked], j[linked]
    if not len(i):
        return []
    n = len(x)
    links = np.bincount(i, weights=rows["copies"][j], minlength=n) + np.bincount(j, weights=rows["copies"][i], minlength=n)
    root = np.arange(n)
    while True:  # smallest label of the neighbours, then of the label's label, until nothing changes
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(int(rows["cid"][v]), int(links[v]), int(rows["cid"][root[v]])) for v in np.flatnonzero(links)]


def _comparer(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, CELL_KEYS):
            rows = {c: part.column(c).to_numpy() for c in ("sub", "cid", "copies", "factor")}
            rows |= {c: part.column(c)[0].as_py() for c in ("table", "bi", "bj")}
            rows["x"] = np.array(part.column("embedding").to_pylist(), dtype=np.float64)
            rows["cells"] = np.array(part.column("cells").to_pylist(), dtype=np.int64)
            rows["code"] = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            if out := _compare_block(rows, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["cid", "links", "root"])

    return run


def usable(v: Column) -> Column:
    """Not null, with finite components that are not all zero."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, rows: int | None = None) -> DataFrame:
    """Link vectors whose cosine is ``threshold`` or more; ``vectors(vec_id, embedding)``.

    Returns ``vec_id, n_links, component_id, kept``, a row for each row. Equal
    vectors are one class and are compared once. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, nor do rows
    without a vec_id: their component is their own id, and they are kept.
    Vectors of different dimensions never link. Repeated rows count as further vectors;
    an empty table gives an empty result; other columns are ignored. The
    tables are sized for a threshold of 0.95 or more.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType
    arrow = pa.float32() if kind.simpleString() == "float" else pa.float64()
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    members = vectors.select("vec_id", F.when(good, F.xxhash64("embedding")).alias("cid"))
    classes = settle(vectors.where(good).groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
                     .withColumn("cid", F.xxhash64("embedding")), "vector_classes")
    k, tables = tables_for(rows or classes.count())
    name = kind.simpleString()
    coded = settle(classes.select("cid", "copies", "embedding").mapInArrow(
        _coder(k, tables, arrow), f"cid long, copies long, embedding array<{name}>, cells array<long>, code binary, factor double"), "codes")
    placed = coded.select("cid", "copies", "embedding", "cells", "code", "factor", F.size("embedding").alias("dims"), F.posexplode("cells").alias("table", "cell"))
    met = blocked(placed, CELL_KEYS, "cid", BLOCK_ROWS)
    found = settle(met.mapInArrow(_comparer(threshold), "cid long, links long, root long"), "vector_links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    groups = settle(classes.select("cid", "first_id", "copies").join(label.withColumnRenamed("id", "cid"), "cid", "left").join(links, "cid", "left")
                    .select("cid", "first_id", "copies", F.coalesce("label", "cid").alias("label"), F.coalesce("links", F.lit(0)).alias("links")), "vector_groups")
    least = settle(groups.groupBy("label").agg(F.min("first_id").alias("component_id")), "vector_least")
    answers = settle(groups.join(least, "label").select("cid", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "vector_answers")
    linked = members.where("cid is not null").join(answers, "cid").select("vec_id", "n_links", "component_id")
    alone = members.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
