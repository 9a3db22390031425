"""Structural detectors: DET-01, 02, 14, 20..23."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions import text
from rowlens.operators.detectors.base import Context, Detector, Outcome
from rowlens.operators.profile import duplicate_groups, duplicate_members
from rowlens.sources.rownum import ROW_NUMBER

NAMES_SHOWN = 5
NAME_DISPLAY = 60
HIGH_SHARE = 0.5


def _exact_duplicate_rows(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    summary = (
        duplicate_groups(ctx.table)
        .agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"))
        .first()
    )
    if summary["groups"]:
        extra = summary["rows"] - summary["groups"]
        key = out.add(
            EXACT_DUPLICATE_ROWS,
            [],
            severity="medium",
            confidence=1.0,
            observation=f"{extra} row(s) repeat another row exactly, in {summary['groups']} group(s).",
            rows=summary["rows"],
            payload={"duplicate_group_count": summary["groups"], "duplicate_row_count": extra},
        )
        out.row_frames.append(
            duplicate_members(ctx.table).select(F.lit(key).alias("finding_key"), ROW_NUMBER)
        )
    return out


def _empty_column(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    for ref, p in ctx.profile.of_type("unknown"):
        out.add(
            EMPTY_COLUMN,
            [ref],
            severity="medium",
            confidence=1.0,
            observation=f"Column '{ref.original_name}' has no value in any row.",
            rows=0,
            payload={"null_count": p["null_count"]},
        )
    return out


def _fully_empty_rows(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    if not ctx.table.columns:
        return out
    blank = ctx.table.all_blank()
    count = ctx.table.df.agg(F.count_if(blank).alias("n")).first()["n"]
    if count:
        total = ctx.profile.row_count
        out.add(
            FULLY_EMPTY_ROWS,
            [],
            severity="low",
            confidence=1.0,
            observation=f"{count} of {total} row(s) are blank in every column.",
            rows=count,
            payload={
                "empty_row_count": count,
                "column_count": len(ctx.table.columns),
                "total_row_count": total,
            },
            flag=blank,
        )
    return out


def name_groups(columns: DataFrame, dataset: list[str] | None = None) -> DataFrame:
    """DET-20 over a table of column names, one group per shared name key.

    `columns(…dataset, ordinal, original_name)`; names are metadata, a few hundred per dataset.
    """
    keys = [*(dataset or []), "name_key"]
    return (
        columns.withColumn("name_key", text.name_key(F.col("original_name")))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("column_count"),
            F.count_distinct("original_name").alias("spellings"),
            F.min("ordinal").alias("first_ordinal"),
        )
        .where(F.col("column_count") >= 2)
    )


def _duplicate_names(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    columns = ctx.table.columns_frame()
    shared = name_groups(columns).select("name_key", "spellings", "first_ordinal")
    keyed = columns.withColumn("name_key", text.name_key(F.col("original_name")))
    members: dict[tuple, list[int]] = {}
    for r in keyed.join(shared, "name_key").orderBy("first_ordinal", "ordinal").collect():
        members.setdefault((r.first_ordinal, r.spellings), []).append(r.ordinal)
    for (_first, spellings), ordinals in members.items():
        refs = [ctx.table.columns[o] for o in ordinals]
        shown = ", ".join(f"'{c.original_name[:NAME_DISPLAY]}'" for c in refs[:NAMES_SHOWN])
        more = f" and {len(refs) - NAMES_SHOWN} more" if len(refs) > NAMES_SHOWN else ""
        identical = spellings == 1
        out.add(
            DUPLICATE_NAMES,
            refs,
            severity="medium",
            confidence=1.0 if identical else 0.9,
            observation=(
                f"{len(refs)} column names are the same apart from case, spacing and "
                f"punctuation: {shown}{more}."
            ),
            rows=0,
            payload={
                "column_count": len(refs),
                "ordinals": ordinals,
                "identical_as_written": identical,
            },
        )
    return out


def empty_datasets(rows: DataFrame, present: Column) -> DataFrame:
    """DET-21 for many datasets at once: those without a row that is `present`."""
    counts = rows.groupBy("dataset").agg(F.count_if(present).alias("row_count"))
    return counts.where("row_count = 0").select("dataset", F.lit("high").alias("severity"), "row_count")


def _empty_dataset(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    if ctx.profile.row_count == 0:
        out.add(
            EMPTY_DATASET,
            [],
            severity="high",
            confidence=1.0,
            observation="There is a header but not a single data row.",
            rows=0,
            payload={"row_count": 0, "column_count": len(ctx.table.columns)},
        )
    return out


def _unnamed_column(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    facts = ctx.facts
    if facts["unnamed_column_count"]:
        refs = [ctx.table.columns[o] for o in facts["unnamed_columns"]]
        count = facts["unnamed_column_count"]
        out.add(
            UNNAMED_COLUMN,
            refs,
            severity="medium",
            confidence=1.0,
            observation=f"{count} of {facts['column_count']} column(s) have a blank header cell.",
            rows=0,
            payload={
                "unnamed_column_count": count,
                "column_count": facts["column_count"],
                "ordinals": [c.ordinal for c in refs],
            },
        )
    return out


def parse_failure_verdict(facts: dict, config: dict) -> dict | None:
    """DET-23 arithmetic on ingest facts."""
    rows = facts["row_count"]
    if not rows:
        return None
    ragged = facts["ragged_row_count"]
    unreadable = (
        facts["formula_without_cached_value_cell_count"] + facts["error_value_cell_count"]
    )
    row_ratio = min(ragged / rows, 1.0)
    cell_ratio = min(unreadable / (rows * max(facts["column_count"], 1)), 1.0)
    floor = config["minimum_count"]
    row_hit = ragged >= floor and row_ratio >= config["row_ratio_threshold"]
    cell_hit = unreadable >= floor and cell_ratio >= config["cell_ratio_threshold"]
    if not (row_hit or cell_hit):
        return None
    worst = max(row_ratio if row_hit else 0.0, cell_ratio if cell_hit else 0.0)
    return {
        "row_hit": row_hit,
        "severity": "high" if worst >= HIGH_SHARE else "medium",
        "payload": {
            "row_count": rows,
            "column_count": facts["column_count"],
            "ragged_row_count": ragged,
            "ragged_row_ratio": round(row_ratio, 4),
            "unreadable_cell_count": unreadable,
            "formula_without_cached_value_cell_count": facts[
                "formula_without_cached_value_cell_count"
            ],
            "error_value_cell_count": facts["error_value_cell_count"],
            "unreadable_cell_ratio": round(cell_ratio, 4),
            **config,
        },
    }


def parse_failure_frame(
    facts: DataFrame, row_ratio_threshold: float = 0.05, minimum_count: int = 5
) -> DataFrame:
    """DET-23's row measure for a table of ingest facts, one row per dataset."""
    ratio = F.least(F.col("ragged_row_count") / F.col("row_count"), F.lit(1.0))
    hit = (F.col("ragged_row_count") >= minimum_count) & (ratio >= row_ratio_threshold)
    return facts.where((F.col("row_count") > 0) & hit).select(
        "dataset",
        F.when(ratio >= HIGH_SHARE, "high").otherwise("medium").alias("severity"),
        F.round(ratio, 4).alias("ragged_row_ratio"),
    )


def _parse_failures(ctx: Context, config: dict) -> Outcome:
    out = Outcome()
    verdict = parse_failure_verdict(ctx.facts, config)
    if verdict:
        p = verdict["payload"]
        # every ragged row, as a frame of row numbers
        rows = ctx.facts["ragged_rows"] if verdict["row_hit"] else None
        key = out.add(
            PARSE_FAILURES,
            [],
            severity=verdict["severity"],
            confidence=1.0,
            observation=(
                f"{p['ragged_row_count']} of {p['row_count']} row(s) are ragged and "
                f"{p['unreadable_cell_count']} cell(s) could not be read."
            ),
            rows=p["ragged_row_count"] if verdict["row_hit"] else 0,
            payload=p,
        )
        if rows is not None:
            out.row_frames.append(rows.select(F.lit(key).alias("finding_key"), F.col(ROW_NUMBER).cast("bigint")))
    return out


def _check_parse_failures(config: dict) -> None:
    for name in ("row_ratio_threshold", "cell_ratio_threshold"):
        if not 0.0 < config[name] <= 1.0:
            raise ValueError(f"{name} must be above 0 and at most 1")
    if config["minimum_count"] < 1:
        raise ValueError("minimum_count must be at least 1")


EXACT_DUPLICATE_ROWS = Detector(
    "structural.exact_duplicate_rows", "Exact duplicate rows", "structural", _exact_duplicate_rows
)
EMPTY_COLUMN = Detector("structural.empty_column", "Empty column", "structural", _empty_column)
FULLY_EMPTY_ROWS = Detector(
    "completeness.fully_empty_rows", "Fully empty rows", "completeness", _fully_empty_rows
)
DUPLICATE_NAMES = Detector(
    "structural.duplicate_normalized_column_name",
    "Duplicate normalized column name",
    "structural",
    _duplicate_names,
)
EMPTY_DATASET = Detector("structural.empty_dataset", "Empty dataset", "structural", _empty_dataset)
UNNAMED_COLUMN = Detector(
    "structural.unnamed_column", "Unnamed column", "structural", _unnamed_column, needs_facts=True
)
PARSE_FAILURES = Detector(
    "structural.excessive_parse_failures",
    "Excessive parse failures",
    "structural",
    _parse_failures,
    needs_facts=True,
    defaults={"row_ratio_threshold": 0.05, "cell_ratio_threshold": 0.05, "minimum_count": 5},
    check=_check_parse_failures,
)
