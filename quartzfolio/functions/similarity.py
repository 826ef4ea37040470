"""Jaro and Jaro-Winkler similarity, for which Spark has no function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, pairs = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                pairs.append(ch)
                break
    if not pairs:
        return 0.0
    swapped = sum(x != y for x, y in zip(pairs, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) / 2
    m = len(pairs)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_of(a: str, b: str, weight: float = 0.1) -> float:
    """The common prefix, four signs at most, counts whatever the similarity."""
    s, prefix = jaro(a, b), 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return s + prefix * weight * (1 - s)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
