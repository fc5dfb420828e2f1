"""Association measures as Column builders (M1-M9).

``ab`` joint frequency, ``a``/``b`` marginals, ``n`` total, ``v`` vocabulary
size; logarithms base 2. ANSI mode raises on ``x / 0``, so every division is
a ``try_divide`` and every log argument is guarded: where numpy yields -inf
or nan the measure is NULL here, and the positive variants turn NULL into
0 (numpy's ``max(0, -inf)`` and ``max(0, nan)`` are both 0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _log2_pos(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def mi(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """M1: ``log2(ab / (a*b/n))``; NULL for ``ab = 0`` or ``a*b = 0``."""
    expected = F.try_divide(a * b, n)
    return _log2_pos(F.try_divide(ab, expected))


def ppmi(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """M2: ``max(0, mi)``."""
    return F.greatest(F.lit(0.0), F.coalesce(mi(ab, a, b, n), F.lit(0.0)))


def laplace(ab: Column, a: Column, b: Column, n: Column, v: Column) -> Column:
    """M3: ``max(0, log2((ab+2) / ((a+1)(b+1)/(n+v))))`` - adds 2 to the
    joint and 1 to each marginal; finite for any non-negative input."""
    expected = F.try_divide((a + 1) * (b + 1), n + v)
    return F.greatest(F.lit(0.0), F.coalesce(_log2_pos(F.try_divide(ab + 2, expected)), F.lit(0.0)))


def mi_strict(ab: Column, a: Column, b: Column, n: Column, strict: bool = False) -> Column:
    """M4: ``log2(ab*n / (a*b))``. A zero marginal is NULL, or - with
    ``strict=True`` - fails the query like the original program exit."""
    denom = a * b
    val = _log2_pos(F.try_divide(ab * n, denom))
    if strict:
        return F.when(denom == 0, F.raise_error(F.lit("association: zero marginal"))).otherwise(val)
    return val


def ppmi_strict(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """M5: positive part of M4."""
    return F.greatest(F.lit(0.0), F.coalesce(mi_strict(ab, a, b, n), F.lit(0.0)))


def lmi(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """M6: local MI ``mi * ab`` (negative for under-represented pairs)."""
    return mi_strict(ab, a, b, n) * ab


def c_prob(f1: Column, f2: Column, lemma_f: Column, n: Column) -> Column:
    """M7: ``f1*f2 / lemma_f * n``, evaluated left to right."""
    return F.try_divide(f1 * f2, lemma_f) * n


def c_prob_simple(bigr_f: Column, lemma_f: Column) -> Column:
    """M8: ``bigr_f / lemma_f``."""
    return F.try_divide(bigr_f, lemma_f)


# M9: the weight functions selectable by name.
WEIGHT_FUNCTIONS: dict[str, Callable[..., Column]] = {"lmi": lmi, "ppmi": ppmi_strict}


def by_name(name: str) -> Callable[..., Column]:
    try:
        return WEIGHT_FUNCTIONS[name]
    except KeyError:
        raise ValueError(f"unknown weight function {name!r}; known: {sorted(WEIGHT_FUNCTIONS)}") from None


def add0(c: Column) -> Column:
    """``-0.0`` and ``0.0`` hash alike after this."""
    return c + F.lit(0.0)
