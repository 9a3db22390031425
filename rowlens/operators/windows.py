"""Rows around a finding (WIN-01..04), for any number of anchors at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.operators.table import Table
from rowlens.sources.rownum import MAX_BROADCAST_ROWS, ROW_NUMBER

# Bounds of one window.
MAX_SIDE = 25
MAX_CHARACTERS = 1_000_000
MAX_ANCHORS = 20


def row_windows(
    table: Table,
    anchors: DataFrame,
    marked: DataFrame | None = None,
    *,
    before: int = 3,
    after: int = 3,
    max_characters: int = MAX_CHARACTERS,
) -> DataFrame:
    """WIN-01: the rows around each anchor row, with truncation and affected marks.

    `anchors(anchor_row)`; `marked(row_number)` are the affected rows. An anchor asks for at
    most 51 row numbers, so the lookup is an equi-join on a unique key, never a range join.
    The table itself is never broadcast: it is scanned where few rows are asked for, else merged.
    """
    rows = table.row_count
    wanted_before = min(max(before, 0), MAX_SIDE)
    wanted_after = min(max(after, 0), MAX_SIDE)
    valid = anchors.select("anchor_row").distinct().where(
        (F.col("anchor_row") >= 0) & (F.col("anchor_row") < rows)
    )
    asked = valid.select(
        "anchor_row",
        F.explode(
            F.sequence(
                F.greatest(F.col("anchor_row") - wanted_before, F.lit(0)),
                F.least(F.col("anchor_row") + wanted_after, F.lit(rows - 1)),
            )
        ).alias(ROW_NUMBER),
    )
    fields = [c.field for c in table.columns]
    cost = sum(
        (F.coalesce(F.length(table.text(c)), F.lit(0)) for c in table.active), F.lit(len(fields))
    )
    # costs are worked out after the join, so that a merge shuffles the table once for both uses
    window = _counted(asked).join(table.df, ROW_NUMBER).withColumn("_cost", cost.cast("bigint"))
    fits = fit_windows(window.select("anchor_row", ROW_NUMBER, "_cost"), max_characters)
    kept = window.join(fits, "anchor_row").where(
        F.col(ROW_NUMBER).between(
            F.col("anchor_row") - F.col("actual_before"), F.col("anchor_row") + F.col("actual_after")
        )
    )
    if marked is not None:
        kept = kept.join(
            _counted(marked.select(ROW_NUMBER, F.lit(True).alias("_marked")).distinct()), ROW_NUMBER, "left"
        )
    else:
        kept = kept.withColumn("_marked", F.lit(False))
    return kept.select(
        "anchor_row",
        ROW_NUMBER,
        (F.col(ROW_NUMBER) == F.col("anchor_row")).alias("is_anchor"),
        F.coalesce("_marked", F.lit(False)).alias("is_affected"),
        (F.col("actual_before") < max(before, 0)).alias("truncated_at_start"),
        (F.col("actual_after") < max(after, 0)).alias("truncated_at_end"),
        "size_limited",
        *fields,
    )


def _counted(side: DataFrame) -> DataFrame:
    """Broadcast a side of short rows only after counting it, else have the join sort and merge.

    Left alone, Spark judges both sides by the bytes of their files. Row numbers and repeated values
    take next to none there, so a table of millions of rows would be built up whole on the driver.
    """
    few = side.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return F.broadcast(side) if few else side.hint("merge")


def fit_windows(costs: DataFrame, budget: int = MAX_CHARACTERS) -> DataFrame:
    """WIN-04: how far each window may reach within a character budget.

    `costs(anchor_row, row_number, _cost)` holds at most 51 rows per anchor. Neighbours are
    taken outward, one before then one after; a side closes at the first row that does not fit.
    """
    distance = F.abs(F.col(ROW_NUMBER) - F.col("anchor_row"))
    steps = F.sort_array(
        F.collect_list(
            F.struct(
                distance.alias("distance"),
                (F.col(ROW_NUMBER) > F.col("anchor_row")).alias("later"),
                F.col("_cost").alias("cost"),
            )
        )
    )
    start = F.struct(
        F.lit(budget).cast("bigint").alias("left"),
        F.lit(0).cast("bigint").alias("before"),
        F.lit(0).cast("bigint").alias("after"),
        F.lit(True).alias("before_open"),
        F.lit(True).alias("after_open"),
    )

    def step(state, s):
        anchor = s["distance"] == 0
        side_open = F.when(s["later"], state["after_open"]).otherwise(state["before_open"])
        fits = anchor | (side_open & (s["cost"] <= state["left"]))
        return F.struct(
            F.when(fits, state["left"] - s["cost"]).otherwise(state["left"]).alias("left"),
            F.when(fits & ~anchor & ~s["later"], s["distance"]).otherwise(state["before"]).cast("bigint").alias("before"),
            F.when(fits & s["later"], s["distance"]).otherwise(state["after"]).cast("bigint").alias("after"),
            (state["before_open"] & (fits | s["later"])).alias("before_open"),
            (state["after_open"] & (fits | ~s["later"])).alias("after_open"),
        )

    grouped = costs.groupBy("anchor_row").agg(
        F.aggregate(steps, start, step).alias("w"),
        F.count(F.lit(1)).alias("asked"),
    )
    return grouped.select(
        "anchor_row",
        F.col("w.before").alias("actual_before"),
        F.col("w.after").alias("actual_after"),
        (F.col("w.before") + F.col("w.after") + 1 < F.col("asked")).alias("size_limited"),
    )


def finding_anchors(finding_rows: DataFrame, finding_key: str, anchor_row: int) -> DataFrame:
    """WIN-01 scope: the anchor must be a row the finding names."""
    hit = finding_rows.where(
        (F.col("finding_key") == finding_key) & (F.col(ROW_NUMBER) == anchor_row)
    )
    return hit.select(F.col(ROW_NUMBER).alias("anchor_row"))


def observation_anchors(observation_rows: DataFrame, observation_key: str) -> DataFrame:
    """WIN-02 scope: an observation's example rows."""
    return observation_rows.where(F.col("observation_key") == observation_key).select(
        F.col(ROW_NUMBER).alias("anchor_row")
    )


def column_wide_anchors(
    findings: DataFrame, finding_columns: DataFrame, observation_rows: DataFrame
) -> DataFrame:
    """WIN-03: anchors of findings that name no rows.

    The first 20 example rows of observations about the same columns, else row 0 (not marked).
    Observations name at most 20 rows per column, so the join is small.
    """
    rowless = findings.where(F.col("affected_row_count") == 0).select("finding_key")
    about = (
        finding_columns.join(rowless, "finding_key", "left_semi")
        .select("finding_key", "ordinal")
        .join(observation_rows.select("ordinal", ROW_NUMBER), "ordinal")
        .select("finding_key", ROW_NUMBER)
        .distinct()
    )
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("finding_key").orderBy(ROW_NUMBER))
    offered = about.withColumn("rank", rank).where(F.col("rank") <= MAX_ANCHORS)
    return rowless.join(offered, "finding_key", "left").select(
        "finding_key",
        F.coalesce(ROW_NUMBER, F.lit(0)).cast("bigint").alias("anchor_row"),
        F.when(F.col(ROW_NUMBER).isNull(), "start_of_file")
        .otherwise("observation_example")
        .alias("anchor_source"),
    )
