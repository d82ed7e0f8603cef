"""Similarity of two texts by their longest common subsequence, 0 to 100, over Arrow batches of pairs.

Apply these to distinct pairs that a cheaper condition has chosen: they are the one place here where built-in functions do not do.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the table is one integer, a bit for each character of a."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str | None, b: str | None) -> float:
    """Twice the common subsequence by the lengths of both; 0 if either is empty or null."""
    return 200 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_sort_ratio_of(a: str | None, b: str | None) -> float:
    return ratio_of(" ".join(sorted((a or "").split())), " ".join(sorted((b or "").split())))


def partial_ratio_of(a: str | None, b: str | None) -> float:
    """The best ratio of the shorter text with a part of the longer one that is no longer than it."""
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    n = len(short)
    return max(ratio_of(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def _vectorised(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return run


def ratio(a, b):
    return _vectorised(ratio_of)(a, b)


def token_sort_ratio(a, b):
    return _vectorised(token_sort_ratio_of)(a, b)


def partial_ratio(a, b):
    return _vectorised(partial_ratio_of)(a, b)
