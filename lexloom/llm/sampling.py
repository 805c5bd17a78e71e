"""Bounded deterministic samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 40


def least_hashed(df: DataFrame, key: str, n: int) -> DataFrame:
    """The `n` rows of least hash of `key`, or all where there are fewer.

    A threshold on the hash leaves about 2n rows before they are ordered, so that the tasks send few rows
    each, however many tasks there are.
    """
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(_RANGE))
    total = df.count()
    if total > 4 * n:
        df = df.where(h < int(_RANGE * 2 * n / total))
    return df.orderBy(h, key).limit(n)
