"""SRC-08: stable 0-based row numbers without a single-task window.

Rows are counted per file (or per written partition); the small per-file counts
get a running sum, and each row adds its own position within the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlens.sources.scratch import materialize

ROW_NUMBER = "row_number"

# A per-file, per-block or per-partition table above this many rows is joined, not broadcast: rows
# hold a path and three numbers, and 100 TB in blocks of 128 MB are 800,000 of them.
MAX_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast a table of short rows only after counting it."""
    few = df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return F.broadcast(df) if few else df


SPLIT_BYTES = 128 * 1024 * 1024


def is_small(df: DataFrame) -> bool:
    """Does the scan read fewer files than there are cores, and little data in all of them?

    Only file names and lengths are looked at; nothing is executed on the data.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not 0 < len(files) < cores:
        return False
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return size < cores * SPLIT_BYTES


def spread(df: DataFrame, small: bool | None = None) -> DataFrame:
    """A small scan with fewer splits than cores is spread over all of them; others are left alone."""
    if not (is_small(df) if small is None else small):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, ROW_NUMBER)


def _add_offsets(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Row number = rows in all earlier groups (in key order) + position in the group.

    One row per file or partition reaches the running-sum window, never one per data row.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    running = W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_offset")
    )
    return df.join(broadcast_if_small(offsets), keys).withColumn(
        ROW_NUMBER, (F.col("_offset") + F.col(position)).cast("long")
    )


def number_file_rows(df: DataFrame) -> DataFrame:
    """Row numbers of a Parquet scan in file order, from the row index the reader knows."""
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_index"),
    )
    numbered = _add_offsets(placed, ["_file"], "_index").drop("_file", "_index", "_offset")
    return spread(numbered, is_small(df))


def number_rows(df: DataFrame, order_by: list) -> DataFrame:
    """Row numbers in the order of `order_by`: range exchange, one write, per-partition offsets."""
    placed = df.orderBy(*order_by).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_index"),
    )
    return _add_offsets(materialize(placed, "ordered"), ["_part"], "_index").drop(
        "_part", "_index", "_offset"
    )
