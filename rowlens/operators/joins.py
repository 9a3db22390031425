"""A join back to rows that holds up when one key owns a third of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more than 1/HOT_FRACTION of the rows is hot, so at most HOT_FRACTION keys are.
HOT_FRACTION = 1000


def skew_safe_join(
    rows: DataFrame, groups: DataFrame, on: list[str], size: str, total_rows: int
) -> DataFrame:
    """Inner join of `rows` with `groups`, which has one row per key and the key's row count.

    Hot keys, at most `HOT_FRACTION` of them by arithmetic, are broadcast and never
    shuffled; every other key owns at most 1/HOT_FRACTION of the rows, so the shuffled
    remainder is even. No row is dropped. Keys match null-safely.
    """
    hot_limit = max(total_rows // HOT_FRACTION, 1)
    hot = groups.where(F.col(size) > hot_limit)
    cold = groups.where(F.col(size) <= hot_limit)
    cold_rows = _match(rows, hot.select(*on), on, "left_anti", bounded=True)
    return _match(rows, hot, on, "inner", bounded=True).unionByName(
        _match(cold_rows, cold, on, "inner", bounded=False)
    )


def _match(left: DataFrame, right: DataFrame, on: list[str], how: str, bounded: bool) -> DataFrame:
    renamed = [F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in right.columns]
    condition: Column | None = None
    for c in on:
        equal = left[c].eqNullSafe(F.col(f"_k_{c}"))
        condition = equal if condition is None else condition & equal
    other = right.select(*renamed)
    joined = left.join(F.broadcast(other) if bounded else other, condition, how)
    return joined if how == "left_anti" else joined.drop(*[f"_k_{c}" for c in on])
