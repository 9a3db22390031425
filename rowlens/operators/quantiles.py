"""Exact weighted percentiles per group (AGG-07..09), bounded in memory.

Linear interpolation between order statistics, as the inclusive method does. The wanted
ranks of all groups are looked up together: an open range of a group with more than
`small_group` rows is cut at the quantiles of a mergeable sketch, the weights of its
buckets say which of them hold a wanted rank, and only these stay open. What is left is
numbered by running weights. A round is two jobs however many groups there are, and a
group of a few rows takes the same way with no round.

A cut value is a bucket of its own, so rows that share one value never keep a range open.
NaN is the largest value; nulls are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SMALL_GROUP = 1_000_000
SPLITS = 64
_RANGES = "range int, ordinal int, low double, high double, below bigint, ranks array<bigint>, cuts array<double>"


@dataclass(frozen=True)
class _Range:
    """Values of a group from `low` to `high`, both included, that hold wanted ranks."""

    ordinal: int
    low: float
    high: float
    below: int
    rows: int
    ranks: tuple[int, ...]


def exact_percentiles(
    values: DataFrame,
    fractions: list[float],
    small_group: int = SMALL_GROUP,
    sizes: dict[int, tuple[int, int]] | None = None,
) -> dict[int, list[float]]:
    """`values(ordinal, v, n)` -> {ordinal: [percentile per fraction]}.

    `sizes` holds (weight, rows) per ordinal when the caller has counted them already.
    On the driver are, per group, at most two ranks a fraction and their ranges.
    """
    values = values.where(F.col("v").isNotNull())
    if sizes is None:
        counted = values.groupBy("ordinal").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
        sizes = {r["ordinal"]: (r["total"], r["rows"]) for r in counted.collect()}
    ranges = [
        _Range(ordinal, -math.inf, math.nan, 0, rows, _ranks(total, fractions))
        for ordinal, (total, rows) in sizes.items()
        if total
    ]
    found: dict[tuple[int, int], float] = {}
    while wide := [r for r in ranges if r.rows > small_group]:
        ranges = [r for r in ranges if r.rows <= small_group]
        for r in _narrowed(values, wide):
            if r.low == r.high or math.isnan(r.low):
                found.update({(r.ordinal, rank): r.low for rank in r.ranks})
            else:
                ranges.append(r)
    found.update(_picked(values, ranges))
    return {
        ordinal: [_interpolate(found, ordinal, f * (total - 1)) for f in fractions]
        for ordinal, (total, _) in sizes.items()
        if total
    }


def _ranks(total: int, fractions: list[float]) -> tuple[int, ...]:
    """0-based ranks on both sides of each wanted position."""
    places = [f * (total - 1) for f in fractions]
    return tuple(sorted({r for p in places for r in (math.floor(p), math.ceil(p))}))


def _interpolate(found: dict[tuple[int, int], float], ordinal: int, position: float) -> float:
    low, high = math.floor(position), math.ceil(position)
    a, b = found[ordinal, low], found[ordinal, high]
    return a if a == b else (high - position) * a + (position - low) * b


def _inside(values: DataFrame, ranges: list[_Range], cuts: dict[int, list[float]] | None = None) -> DataFrame:
    """Rows of the ranges. Ranges of a group are disjoint: a row is in one at most."""
    listed = [
        (i, r.ordinal, r.low, r.high, r.below, list(r.ranks), (cuts or {}).get(i, [])) for i, r in enumerate(ranges)
    ]
    table = values.sparkSession.createDataFrame(listed, _RANGES)
    return values.join(F.broadcast(table), "ordinal").where(F.col("v").between(F.col("low"), F.col("high")))


def _narrowed(values: DataFrame, ranges: list[_Range]) -> list[_Range]:
    """The parts of each range that hold its ranks."""
    shares = [i / SPLITS for i in range(1, SPLITS)]
    sketched = _inside(values, ranges).groupBy("range").agg(F.percentile_approx("v", shares, 10_000).alias("cuts"))
    cuts = {r["range"]: sorted({c for c in r["cuts"] if not math.isnan(c)}) for r in sketched.collect()}
    v = F.col("v")
    bucket = F.size(F.filter("cuts", lambda c: c < v)) + F.size(F.filter("cuts", lambda c: c <= v))
    counted = (
        _inside(values, ranges, cuts)
        .groupBy("range", bucket.alias("bucket"), F.isnan("v").alias("nan"))
        .agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
        .orderBy("range", "bucket", "nan")
        .collect()
    )
    out, below = [], {i: r.below for i, r in enumerate(ranges)}
    for b in counted:
        whole, start = ranges[b["range"]], below[b["range"]]
        below[b["range"]] = upto = start + b["weight"]
        held = tuple(r for r in whole.ranks if start <= r < upto)
        if held:
            out.append(_Range(whole.ordinal, b["low"], b["high"], start, b["rows"], held))
    return out


def _picked(values: DataFrame, ranges: list[_Range]) -> dict[tuple[int, int], float]:
    """Values at the ranks, by running weights over the rows of each range."""
    if not ranges:
        return {}
    running = W.partitionBy("range").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = _inside(values, ranges).withColumn("upto", F.col("below") + F.sum("n").over(running))
    upto, before = F.col("upto"), F.col("upto") - F.col("n")
    hits = placed.select("ordinal", "v", F.explode(F.filter("ranks", lambda r: (before <= r) & (r < upto))).alias("rank"))
    return {(r["ordinal"], r["rank"]): r["v"] for r in hits.collect()}
