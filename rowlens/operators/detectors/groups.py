"""Detectors whose findings are groups of values: DET-05 and DET-19.

The number of groups depends on the data, so groups, their spellings and their rows stay
DataFrames. Spellings are rows of `finding_values`, not an array on the finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions import text
from rowlens.operators.cells import cells
from rowlens.operators.detectors.base import Context, Detector, Outcome, digest
from rowlens.operators.joins import skew_safe_join
from rowlens.operators.profile import TEXT_FAMILY
from rowlens.operators.table import ColumnRef
from rowlens.sources.rownum import ROW_NUMBER
from rowlens.sources.scratch import materialize

VARIANTS_SHOWN = 10
VARIANT_DISPLAY = 60


def spelling_groups(
    vf: DataFrame, key: Column, spelling: Column, keep: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(spellings, groups): one row per (ordinal, key, spelling), and keys with two or more.

    Texts of any length are grouped and joined by digest; each digest carries its text once.
    """
    values = vf.where(~text.is_blank(F.col("value"))).select(
        "ordinal", key.alias("key"), spelling.alias("spelling"), "n", "first_row"
    )
    if keep is not None:
        values = values.where(keep)
    values = values.select("*", digest(F.col("key")).alias("key_id"), digest(F.col("spelling")).alias("spelling_id"))
    spellings = values.groupBy("ordinal", "key_id", "spelling_id").agg(
        F.first("key").alias("key"),
        F.first("spelling").alias("spelling"),
        F.sum("n").alias("n"),
        F.min("first_row").alias("first_row"),
    )
    groups = (
        spellings.groupBy("ordinal", "key_id")
        .agg(
            F.first("key").alias("key"),
            F.count(F.lit(1)).alias("variants"),
            F.sum("n").alias("affected_row_count"),
            F.min("first_row").alias("first_row"),
        )
        .where(F.col("variants") >= 2)
    )
    return spellings, groups


def _assemble(
    ctx: Context,
    detector: Detector,
    refs: list[ColumnRef],
    key: Column,
    spelling: Column,
    keep: Column | None,
    confidence: float,
    ordered_by_first_row: bool,
) -> Outcome:
    out = Outcome()
    if not refs:
        return out
    spellings, groups = spelling_groups(ctx.profile.vf_of(refs), key, spelling, keep)
    groups = materialize(groups, "groups")
    if groups.isEmpty():
        return out
    by_ordinal = {c.ordinal: c for c in refs}
    column_key = F.create_map(*[F.lit(x) for o, c in by_ordinal.items() for x in (o, c.internal_key)])
    column_name = F.create_map(
        *[F.lit(x) for o, c in by_ordinal.items() for x in (o, c.original_name)]
    )
    finding_key = F.concat_ws(".", F.lit(detector.id), column_key[F.col("ordinal")], F.col("key"))
    out.finding_frames.append(
        groups.select(
            finding_key.alias("finding_key"),
            F.lit(detector.id).alias("detector_id"),
            F.lit(detector.category).alias("category"),
            F.lit("low").alias("severity"),
            F.lit(confidence).alias("confidence"),
            F.format_string(
                "Column '%s' writes one value in %d ways over %d row(s).",
                column_name[F.col("ordinal")],
                F.col("variants"),
                F.col("affected_row_count"),
            ).alias("observation"),
            F.col("ordinal").alias("first_ordinal"),
            (F.col("first_row") if ordered_by_first_row else F.lit(0).cast("bigint")).alias(
                "group_position"
            ),
            (F.lit("") if ordered_by_first_row else F.col("key")).alias("group_text"),
            "affected_row_count",
            F.to_json(
                F.struct(F.col("variants").alias("variant_count"), "affected_row_count")
            ).alias("payload"),
        )
    )
    # One row per spelling of a flagged key: joined on the key, sized by its spellings.
    total = ctx.profile.row_count * len(refs)
    out.value_frames.append(
        skew_safe_join(
            spellings.select("ordinal", "key_id", "spelling"),
            groups.select("ordinal", "key_id", "key", "variants"),
            ["ordinal", "key_id"],
            "variants",
            total,
        ).select(finding_key.alias("finding_key"), F.col("spelling").alias("value"))
    )
    # The key expression runs on cells exactly as it ran on distinct values.
    keyed = cells(ctx.table, refs).where(~text.is_blank(F.col("value"))).select(
        ROW_NUMBER, "ordinal", digest(key).alias("key_id")
    )
    out.row_frames.append(
        skew_safe_join(
            keyed,
            groups.select("ordinal", "key_id", "key", "affected_row_count"),
            ["ordinal", "key_id"],
            "affected_row_count",
            total,
        ).select(finding_key.alias("finding_key"), ROW_NUMBER)
    )
    return out


def _capitalization(ctx: Context, _: dict) -> Outcome:
    value = F.col("value")
    return _assemble(
        ctx,
        CAPITALIZATION,
        [ref for ref, _ in ctx.profile.of_type(*TEXT_FAMILY)],
        text.casing_key(value),
        text.strip(value),
        None,
        1.0,
        ordered_by_first_row=True,
    )


def _near_duplicates(ctx: Context, _: dict) -> Outcome:
    value = F.col("value")
    return _assemble(
        ctx,
        NEAR_DUPLICATES,
        [ref for ref, _ in ctx.profile.of_type("categorical")],
        text.near_duplicate_key(text.strip(value)),
        text.casing_key(value),
        text.usable_near_duplicate_key(F.col("key")),
        0.8,
        ordered_by_first_row=False,
    )


def variants_shown(values: DataFrame) -> DataFrame:
    """DET-19 display list: the first spellings in text order, each bounded for display."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("finding_key").orderBy("value"))
    return (
        values.withColumn("rank", rank)
        .where(F.col("rank") <= VARIANTS_SHOWN)
        .select("finding_key", "rank", F.substring("value", 1, VARIANT_DISPLAY).alias("variant"))
    )


CAPITALIZATION = Detector(
    "consistency.inconsistent_capitalization",
    "Inconsistent capitalization",
    "consistency",
    _capitalization,
)
NEAR_DUPLICATES = Detector(
    "consistency.near_duplicate_categories",
    "Near-duplicate categories",
    "consistency",
    _near_duplicates,
)
