"""Fuzzy ratios (Z1-Z4) on Arrow batches.

The base is the normalized Indel similarity, 200 * LCS / (len a + len b), with the longest
common subsequence by bit-parallel rows (Hyyrö 2004; Crochemore et al. 2001) on Python integers.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    if not a or not b:
        return 0
    if a == b:
        return len(a)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200 * lcs(a, b) / total if total else 100.0


@lru_cache(50_000)
def tokens(text: str) -> tuple[str, ...]:
    return tuple(sorted(text.split()))


def token_sort(a: str, b: str) -> float:
    """Words in order, repeated ones too."""
    return indel(" ".join(tokens(a)), " ".join(tokens(b)))


def token_set(a: str, b: str) -> float:
    """100 when one's words are all in the other; else the best of three comparisons."""
    x, y = set(tokens(a)), set(tokens(b))
    if not x or not y:
        return 0.0
    shared, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not left or not right):
        return 100.0
    s, p, q, gap = len(shared), len(left), len(right), 1 if shared else 0
    long_a, long_b = s + gap + p, s + gap + q
    best = 100 - 100 * (p + q - 2 * lcs(left, right)) / (long_a + long_b)
    if s:
        best = max(best, 100 - 100 * (gap + p) / (s + long_a), 100 - 100 * (gap + q) / (s + long_b))
    return best


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x or "", y or "") for x, y in zip(a, b)])


def name_score(a: Column, b: Column) -> Column:
    """Z3."""
    return 0.55 * token_set_ratio(a, b) + 0.45 * token_sort_ratio(a, b)


def same_supplier(a: Column, b: Column, cut: float = 88) -> Column:
    """F14, for normalized names: both given, and alike."""
    return (a != "") & (b != "") & (token_set_ratio(a, b) >= cut)
