"""Fuzzy string scores on distinct pairs, in Arrow batches.

Similarity of two strings is 1 - indel distance / total length, that is 2 * LCS / (|a| + |b|).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _masks(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def lcs(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a bit per character of a."""
    masks = masks or _masks(a)
    full = row = (1 << len(a)) - 1
    for c in b:
        m = row & masks.get(c, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str, cutoff: float = 0.0) -> float:
    """The best similarity of the shorter string to a window of the longer, of its length or clipped at either end.

    A score below the cutoff comes out as 0.  A window is measured only if the characters it shares with the shorter
    string, counted as the window slides, could lift the best score.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 1.0
    if a in b:
        return 1.0
    masks, n, best = _masks(a), len(a), 0.0
    left = {c: m.bit_count() for c, m in masks.items()}  # characters of a that the window still lacks; below 0: too many
    common = 0
    for end in range(1, len(b) + n):
        if end <= len(b) and (c := b[end - 1]) in left:
            common += left[c] > 0
            left[c] -= 1
        if end > n and (c := b[end - n - 1]) in left:
            left[c] += 1
            common -= left[c] > 0
        low, high = max(0, end - n), min(len(b), end)
        bound = 2 * common / (n + high - low)
        if bound > best and bound >= cutoff:
            best = max(best, 2 * lcs(a, b[low:high], masks) / (n + high - low))
    return best if best >= cutoff else 0.0


def token_set_ratio(a: str, b: str) -> float:
    """The best of the ratios among shared words, shared and own words of one side, and of the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 1.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    out = ratio(left, right)
    if both:
        out = max(out, ratio(both, left), ratio(both, right))
    return out


@F.pandas_udf(T.DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def partial_ratio_column(a: Column, b: Column) -> Column:
    return _partial(a, b)


def partial_ratio_reaches(a: Column, b: Column, bar: float) -> Column:
    """Whether the score is at least the bar, which spares most of the windows."""

    @F.pandas_udf(T.BooleanType())
    def reaches(x: pd.Series, y: pd.Series) -> pd.Series:
        told: dict = {}  # pairs of a batch that repeat are scored once
        for pair in zip(x, y):
            if None not in pair and pair not in told:
                told[pair] = partial_ratio(*pair, bar) >= bar
        return pd.Series([told.get(pair) for pair in zip(x, y)], dtype="object")

    return reaches(a, b)


def token_set_ratio_column(a: Column, b: Column) -> Column:
    return _token_set(a, b)
