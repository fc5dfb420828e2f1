"""Vector expressions on ``array<double>`` columns (P6, P7 building blocks).

Higher-order functions keep the arithmetic inside the JVM; no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of element products; NULL when the sizes differ."""
    prods = F.zip_with(a, b, lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def cosine(a: Column, b: Column) -> Column:
    """``dot / (|a| |b|)``; NULL for a size mismatch or a zero vector
    (where the reference prints the vectors and returns None/nan)."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vec_sum(vs: Column) -> Column:
    """Element-wise sum of a (bounded) array of equally long vectors, in
    array order."""
    first = F.element_at(vs, 1)
    zero = F.transform(first, lambda x: F.lit(0.0))
    return F.aggregate(vs, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))


def scale(v: Column, d: Column) -> Column:
    return F.transform(v, lambda x: x / d)


def vec_key(lemma: Column, pos: Column, with_pos: bool = False) -> Column:
    """Vector lookup key ``form`` or ``form/pos``."""
    return F.concat_ws("/", lemma, pos) if with_pos else lemma
