"""Batches of bounded size for user models (U1), run inside the tasks.

A sentence of n pieces asks a masked model for n variants of n pieces. Variants
are gathered into batches whose padded size, variants times longest sentence,
stays within a budget of tokens. Sentences come in ascending length, so little
of a batch is padding; a sentence too long for one batch is split by targets.

The functions here travel to the executors by value, so these need not have
the package installed.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from ..constants import CONT_PREFIX, SPECIAL_TOKENS, WORD_MARKER

#: Tokens of a padded batch.
BATCH_TOKENS = 32_768

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mask_ends(pcs: list[str], kind: str, style: str = "prefix") -> np.ndarray:
    """Last masked position (1-based) for each piece of a sentence as target."""
    n = len(pcs)
    if kind == "plain":
        return np.arange(1, n + 1)
    if kind == "l2r":
        return np.full(n, n)
    if style == "prefix":
        start = [not p.startswith(CONT_PREFIX) for p in pcs]
    else:
        start = [i == 0 or p in (*SPECIAL_TOKENS, ".") or p.startswith(WORD_MARKER) or pcs[i - 1] == "." for i, p in enumerate(pcs)]
    at = np.flatnonzero(start)
    nxt = np.searchsorted(at, np.arange(n), side="right")
    return np.append(at, n)[nxt]


def token_batches(lengths: Sequence[int], budget: int) -> Iterator[list[tuple[int, int, int]]]:
    """Batches of ``(row, first target, targets)`` for rows of ascending length.

    Targets times the longest length stay within ``budget``; only a variant
    that is longer by itself exceeds it, as a batch of one.
    """
    batch: list[tuple[int, int, int]] = []
    held = 0
    for row, n in enumerate(lengths):
        at = 0
        while at < n:
            room = budget // n - held
            if batch and (room <= 0 or (room < n - at and (at == 0 and n * n <= budget))):
                yield batch
                batch, held = [], 0
                continue
            take = max(1, min(n - at, room))
            batch.append((row, at, take))
            held, at = held + take, at + take
    if batch:
        yield batch


def padded_variants(batch: pd.DataFrame, mask: str = "[MASK]", pad: str = "[PAD]") -> tuple[np.ndarray, np.ndarray]:
    """The masked and padded variants of a batch, one row a target, and the position (0-based) of each target."""
    longest = max(map(len, batch.pcs))
    rows, targets = [], []
    for pcs, low, high in zip(batch.pcs, batch.mask_from, batch.mask_to, strict=True):
        for i, j in zip(low, high, strict=True):
            rows.append([*pcs[:i - 1], *[mask] * (j - i + 1), *pcs[j:], *[pad] * (longest - len(pcs))])
            targets.append(i - 1)
    return np.array(rows, dtype=object), np.array(targets)


def corpus_model(batch: pd.DataFrame) -> list[np.ndarray]:
    """The U2 arithmetic in numpy, as a model for ``score_with_udf``."""
    out = []
    for left, right, frm, to in zip(batch.left_bi, batch.right_gain, batch.mask_from, batch.mask_to, strict=True):
        own = np.asarray(frm) - 1
        gain = np.asarray(right, dtype=np.float64)[own]
        visible = (own + 2 > to) & ~np.isnan(gain)
        out.append(np.asarray(left, dtype=np.float64)[own] + np.where(visible, gain, 0.0))
    return out


def runner(fn: Callable[[pd.DataFrame], list], kind: str, style: str, budget: int):
    """The function for ``mapInPandas``: rows ``sent_id, pcs, ...`` to ``sent_id, target_pos, logprob``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf.pcs.map(lambda p: 0 if p is None else len(p)).to_numpy()
            order = np.argsort(n, kind="stable")
            pdf = pdf.iloc[order[n[order] > 0]].reset_index(drop=True)
            ends: dict[int, np.ndarray] = {}
            for batch in token_batches(np.sort(n[n > 0]).tolist(), budget):
                ends = {r: ends[r] if r in ends else mask_ends(list(pdf.pcs[r]), kind, style) for r, _, _ in batch}
                part = pdf.iloc[[r for r, _, _ in batch]].reset_index(drop=True)
                part["mask_from"] = [np.arange(at + 1, at + k + 1) for _, at, k in batch]
                part["mask_to"] = [ends[r][at:at + k] for r, at, k in batch]
                scores = fn(part)
                if [len(s) for s in scores] != [k for _, _, k in batch]:
                    raise ValueError("the model must return one log-probability per target")
                yield pd.DataFrame({
                    "sent_id": np.repeat(part.sent_id.to_numpy(), [k for _, _, k in batch]), "target_pos": np.concatenate(list(part.mask_from)).astype(np.int32),
                    "logprob": np.concatenate([np.asarray(s, dtype=np.float64) for s in scores])})

    return run
