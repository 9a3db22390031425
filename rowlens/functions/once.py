"""Keep an expensive column from being computed twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_once(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without recomputing them.

    A filter on a column is normally pushed below the projection that computes it, where the
    whole expression runs again. A filter that also reads an id of the projection stays above it.
    """
    pinned = df.withColumn("_pin", F.monotonically_increasing_id())
    return pinned.where(condition & (F.col("_pin") >= 0)).drop("_pin")
