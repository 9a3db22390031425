"""AGG-01: the value-frequency table, from one unpivot and one partial + final aggregation.

    rows(row_number, c0..cn) -> cells(row_number, ordinal, value, num)
                             -> vf(ordinal, value, num, n, first_row)

A value repeated in a third of all rows is combined map-side before the shuffle.
Floating-point columns keep their number (`num`) and are never rendered to text;
every other kind is grouped by its exact text (`value`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions import text
from rowlens.operators.table import ColumnRef, Table
from rowlens.sources.rownum import ROW_NUMBER


def _unpivot(table: Table, columns: list[ColumnRef], as_number: bool) -> DataFrame:
    picked = [
        (F.col(f"`{c.field}`").cast("double") if as_number else table.text(c)).alias(str(c.ordinal))
        for c in columns
    ]
    wide = table.df.select(ROW_NUMBER, *picked)
    return wide.unpivot(ROW_NUMBER, [str(c.ordinal) for c in columns], "ordinal", "cell").select(
        ROW_NUMBER,
        F.col("ordinal").cast("int").alias("ordinal"),
        (F.lit(None).cast("string") if as_number else F.col("cell")).alias("value"),
        (F.col("cell") if as_number else F.lit(None).cast("double")).alias("num"),
    )


def cells(table: Table, columns: list[ColumnRef] | None = None) -> DataFrame:
    """One row per non-missing cell. Never stored."""
    chosen = [c for c in (columns if columns is not None else table.active) if c.kind != "skip"]
    doubles = [c for c in chosen if c.kind == "double"]
    others = [c for c in chosen if c.kind != "double"]
    parts = [_unpivot(table, cs, flag) for cs, flag in ((others, False), (doubles, True)) if cs]
    if not parts:
        raise ValueError("the table has no column that can be profiled")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.where(F.col("num").isNotNull() | ~text.is_missing(F.col("value")))


def value_frequencies(table: Table, columns: list[ColumnRef] | None = None) -> DataFrame:
    return (
        cells(table, columns)
        .groupBy("ordinal", "value", "num")
        .agg(F.count(F.lit(1)).alias("n"), F.min(ROW_NUMBER).alias("first_row"))
    )


def vf_text() -> Column:
    return F.coalesce(F.col("value"), F.col("num").cast("string"))


def vf_number() -> Column:
    return F.coalesce(F.col("num"), text.to_double(F.col("value")))


def vf_shape() -> Column:
    return F.when(F.col("num").isNotNull(), "numeric").otherwise(text.value_shape(F.col("value")))


def top_values(vf: DataFrame, k: int = 5) -> DataFrame:
    """AGG-06: the k most frequent values per column, ties by first appearance.

    The rank filter is pushed below the shuffle as a per-partition group limit, so a
    column's task receives at most k rows per input partition.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("ordinal").orderBy(F.desc("n"), F.asc("first_row"))
    return (
        vf.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("ordinal", "rank", vf_text().alias("value"), "n")
    )
