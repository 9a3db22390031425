"""Observation-only detectors: DET-24, 25, 26. They state facts and never score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlens.functions import text
from rowlens.functions.dates import DATE_FAMILIES, date_family
from rowlens.operators.cells import vf_shape
from rowlens.operators.detectors.base import MAX_EXAMPLE_ROWS, Context, Detector, Outcome
from rowlens.operators.table import ColumnRef, Table
from rowlens.sources.rownum import ROW_NUMBER
from rowlens.sources.scratch import materialize

# Value shapes in tie-break order.
SHAPES = ("boolean", "date", "numeric", "text")
RUN_CHUNK = 1_000_000


def label_counts(vf: DataFrame, label) -> DataFrame:
    """Rows per (ordinal, label) from the frequency table; a null label is counted too."""
    return vf.groupBy("ordinal", label.alias("label")).agg(F.sum("n").alias("n"))


def dominant(counts: dict[str, int], order: tuple[str, ...]) -> str:
    """The most frequent label, ties to the earlier one in the fixed order."""
    return max(order, key=lambda name: (counts.get(name, 0), -order.index(name)))


def _by_column(frame: DataFrame) -> dict[int, dict]:
    out: dict[int, dict] = {}
    for r in frame.collect():
        out.setdefault(r.ordinal, {})[r.label] = r.n
    return out


def _mixed_types(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    mixed = ctx.profile.of_type("mixed")
    if not mixed:
        return out
    counts = _by_column(label_counts(ctx.text_values("mixed"), vf_shape()))
    noted, conditions = [], []
    for ref, _p in mixed:
        shapes = counts[ref.ordinal]
        present = [s for s in SHAPES if shapes.get(s)]
        if len(present) < 2:
            continue
        top = dominant(shapes, SHAPES)
        value = ctx.table.text(ref)
        conditions.append(~ctx.table.missing(ref) & (text.value_shape(value) != top))
        total = sum(shapes.values())
        noted.append((
            ref,
            f"Column '{ref.original_name}' has {total} value(s) in {len(present)} shapes: "
            + ", ".join(f"{shapes[s]} {s}" for s in present),
            {
                "non_blank_count": total,
                "shape_counts": {s: shapes[s] for s in present},
                "dominant_shape": top,
            },
        ))
    for note, rows in zip(noted, ctx.first_rows_of(conditions), strict=True):
        out.observe(MIXED_TYPES, *note, rows)
    return out


def _date_formats(ctx: Context, config: dict) -> Outcome:
    out = Outcome()
    threshold = config["minimum_date_like_ratio"]
    text_refs = [c for c in ctx.table.columns if c.kind == "text"]
    if not text_refs:
        return out
    counts = _by_column(label_counts(ctx.profile.vf_of(text_refs), date_family(F.col("value"))))
    noted, conditions = [], []
    for ref in text_refs:
        families = {k: v for k, v in counts.get(ref.ordinal, {}).items() if k}
        non_blank = sum(counts.get(ref.ordinal, {}).values())
        date_like = sum(families.values())
        if len(families) < 2 or date_like / non_blank < threshold:
            continue
        top = dominant(families, DATE_FAMILIES)
        present = [f for f in DATE_FAMILIES if f in families]
        conditions.append(date_family(ctx.table.text(ref)) != top)
        noted.append((
            ref,
            f"Column '{ref.original_name}' writes {date_like} date(s) in {len(present)} formats: "
            + ", ".join(f"{families[f]} {f}" for f in present),
            {
                "non_blank_count": non_blank,
                "date_like_count": date_like,
                "format_counts": {f: families[f] for f in present},
                "dominant_format": top,
                "minimum_date_like_ratio": threshold,
            },
        ))
    for note, rows in zip(noted, ctx.first_rows_of(conditions), strict=True):
        out.observe(DATE_FORMATS, *note, rows)
    return out


def missing_runs(table: Table, columns: list[ColumnRef], chunk: int = RUN_CHUNK) -> DataFrame:
    """DET-26: the longest run of consecutive missing rows per column.

    Rows blank in every column are left out first. Rows are cut into equal chunks of row
    numbers, so no window sees more than one chunk; runs that touch a chunk edge, at most two
    per chunk and column, are stitched afterwards. Ties go to the first run.
    """
    flags = [
        F.when(table.missing(c), F.lit(c.ordinal)) for c in columns
    ]
    kept = table.df.where(~table.all_blank()).select(
        ROW_NUMBER,
        F.floor(F.col(ROW_NUMBER) / chunk).alias("chunk"),
        F.array_compact(F.array(*flags)).alias("gaps"),
    )
    in_chunk = W.partitionBy("chunk").orderBy(ROW_NUMBER)
    placed = kept.withColumn("pos", F.row_number().over(in_chunk))
    sizes = placed.groupBy("chunk").agg(F.max("pos").alias("size"))
    before = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "chunk", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")
    )
    missing = placed.select("chunk", "pos", ROW_NUMBER, F.explode("gaps").alias("ordinal"))
    in_column = W.partitionBy("chunk", "ordinal").orderBy("pos")
    runs = (
        missing.withColumn("island", F.col("pos") - F.row_number().over(in_column))
        .groupBy("chunk", "ordinal", "island")
        .agg(
            F.count(F.lit(1)).alias("length"),
            F.min("pos").alias("start"),
            F.max("pos").alias("stop"),
            F.min(ROW_NUMBER).alias("first_row"),
            F.max(ROW_NUMBER).alias("last_row"),
        )
        .join(offsets, "chunk")
    )
    runs = materialize(
        runs.select(
            "ordinal", "length", "first_row", "last_row",
            (F.col("start") + F.col("offset")).alias("start"),
            (F.col("stop") + F.col("offset")).alias("stop"),
            ((F.col("start") == 1) | (F.col("stop") == F.col("size"))).alias("edge"),
        ),
        "runs",
    )
    edges = runs.where("edge")
    by_start = W.partitionBy("ordinal").orderBy("start")
    joins_previous = F.col("start") == F.lag("stop").over(by_start) + 1
    stitched = (
        edges.withColumn("new", F.when(joins_previous, 0).otherwise(1))
        .withColumn("run", F.sum("new").over(by_start))
        .groupBy("ordinal", "run")
        .agg(
            F.sum("length").alias("length"),
            F.min("first_row").alias("first_row"),
            F.max("last_row").alias("last_row"),
        )
        .drop("run")
    )
    whole = runs.where(~F.col("edge")).select("ordinal", "length", "first_row", "last_row")
    best = F.max_by(
        F.struct("length", "first_row", "last_row"), F.struct("length", -F.col("first_row"))
    )
    totals = runs.groupBy("ordinal").agg(F.sum("length").alias("missing_count"))
    return (
        whole.unionByName(stitched)
        .groupBy("ordinal")
        .agg(best.alias("best"))
        .join(totals, "ordinal")
        .select("ordinal", "missing_count", "best.*")
    )


def _concentrated_missing(ctx: Context, config: dict) -> Outcome:
    out = Outcome()
    minimum, share_floor = config["minimum_run_length"], config["concentration_ratio"]
    candidates = [
        ref
        for ref, p in zip(ctx.table.columns, ctx.profile.columns, strict=True)
        if p["null_count"] >= minimum and p["null_count"] < ctx.profile.row_count
    ]
    if not candidates:
        return out
    blank = ctx.table.df.agg(F.count_if(ctx.table.all_blank()).alias("n")).first()["n"]
    kept = ctx.profile.row_count - blank
    if kept < minimum:
        return out
    runs = {r.ordinal: r for r in missing_runs(ctx.table, candidates).collect()}
    noted, conditions = [], []
    for ref in candidates:
        r = runs.get(ref.ordinal)
        if r is None or r.missing_count < minimum or r.missing_count == kept:
            continue
        share = r.length / r.missing_count
        if r.length < minimum or share < share_floor:
            continue
        inside = F.col(ROW_NUMBER).between(r.first_row, r.last_row)
        conditions.append(inside & ctx.table.missing(ref) & ~ctx.table.all_blank())
        noted.append((
            ref,
            f"Column '{ref.original_name}' is missing in {r.missing_count} of {kept} row(s); "
            f"{r.length} of them run from row {r.first_row} to row {r.last_row}.",
            {
                "row_count": kept,
                "excluded_blank_row_count": blank,
                "missing_count": r.missing_count,
                "longest_run_length": r.length,
                "run_share": round(share, 4),
                "first_row_number": r.first_row,
                "last_row_number": r.last_row,
                "minimum_run_length": minimum,
                "concentration_ratio": share_floor,
            },
        ))
    for note, rows in zip(noted, ctx.first_rows_of(conditions), strict=True):
        out.observe(CONCENTRATED_MISSING, *note, rows)
    return out


def _check_ratio(name: str):
    def check(config: dict) -> None:
        if not 0.0 < config[name] <= 1.0:
            raise ValueError(f"{name} must be above 0 and at most 1")

    return check


def _check_missing(config: dict) -> None:
    _check_ratio("concentration_ratio")(config)
    if config["minimum_run_length"] < 2:
        raise ValueError("minimum_run_length must be at least 2")


MIXED_TYPES = Detector("structural.mixed_types", "Mixed types", "structural", _mixed_types)
DATE_FORMATS = Detector(
    "consistency.inconsistent_date_formats",
    "Inconsistent date formats",
    "consistency",
    _date_formats,
    defaults={"minimum_date_like_ratio": 0.5},
    check=_check_ratio("minimum_date_like_ratio"),
)
CONCENTRATED_MISSING = Detector(
    "completeness.concentrated_missingness",
    "Concentrated missingness",
    "completeness",
    _concentrated_missing,
    defaults={"minimum_run_length": 5, "concentration_ratio": 0.8},
    check=_check_missing,
)
__all__ = ["CONCENTRATED_MISSING", "DATE_FORMATS", "MAX_EXAMPLE_ROWS", "MIXED_TYPES", "missing_runs"]
