"""Column names for many files at once (SRC-03) and their warnings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlens.functions.text import strip

HEADER_SCHEMA = (
    "file string, ordinal int, original_name string, internal_key string, was_empty boolean, "
    "was_cut boolean, was_duplicate boolean"
)


def normalize_headers(headers: DataFrame, max_length: int | None = None) -> DataFrame:
    """headers(file, ordinal, name) -> display names, unique keys and warning flags.

    Names are kept whole unless `max_length` is given.

    The n-th use of a base key in a file gets the suffix `_n`. Only files in which a suffixed key
    meets a key spelled that way are settled cell by cell, one file's header per group.
    """
    raw = F.coalesce("name", F.lit(""))
    named = headers.select(
        "file",
        F.col("ordinal").cast("int").alias("ordinal"),
        F.when(raw == "", F.concat(F.lit("column_"), F.col("ordinal").cast("string")))
        .otherwise(raw)
        .alias("full"),
        (raw == "").alias("was_empty"),
    ).select(
        "file",
        "ordinal",
        (F.substring("full", 1, max_length) if max_length else F.col("full")).alias("original_name"),
        "was_empty",
        (F.length("full") > max_length if max_length else F.lit(False)).alias("was_cut"),
    )
    joined = F.regexp_replace(F.lower(strip(F.col("original_name"))), "[^a-z0-9]+", "_")
    base = F.regexp_replace(joined, "^_+|_+$", "")
    keyed = named.withColumn("base", F.when(base == "", "column").otherwise(base))
    # A header is at most a few hundred cells, so a file is a small window partition.
    nth = F.row_number().over(W.partitionBy("file", "base").orderBy("ordinal"))
    suffixed = keyed.withColumn("nth", nth).withColumn(
        "internal_key",
        F.when(F.col("nth") == 1, F.col("base")).otherwise(
            F.concat_ws("_", "base", F.col("nth").cast("string"))
        ),
    )
    clash = F.count(F.lit(1)).over(W.partitionBy("file", "internal_key")) > 1
    marked = suffixed.withColumn("clash", F.max(clash).over(W.partitionBy("file")))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        keys = []
        pdf = pdf.sort_values("ordinal")
        for base_key in pdf["base"]:
            key, n = base_key, 2
            while key in used:
                key, n = f"{base_key}_{n}", n + 1
            used.add(key)
            keys.append(key)
        pdf["internal_key"] = keys
        pdf["was_duplicate"] = pdf["internal_key"] != pdf["base"]
        return pdf[
            ["file", "ordinal", "original_name", "internal_key", "was_empty", "was_cut", "was_duplicate"]
        ]

    plain = marked.where(~F.col("clash")).select(
        "file", "ordinal", "original_name", "internal_key", "was_empty", "was_cut",
        (F.col("nth") > 1).alias("was_duplicate"),
    )
    settled = marked.where("clash").groupBy("file").applyInPandas(settle, HEADER_SCHEMA)
    return plain.unionByName(settled)


def header_warnings(normalized: DataFrame) -> DataFrame:
    """One warning row per code and column."""
    codes = F.array_compact(
        F.array(
            F.when(F.col("was_empty"), F.lit("parsing.empty_column_name")),
            F.when(F.col("was_cut"), F.lit("parsing.column_name_truncated")),
            F.when(F.col("was_duplicate"), F.lit("parsing.duplicate_column_name")),
        )
    )
    return normalized.select("file", "ordinal", F.explode(codes).alias("code"))
