"""Column and dataset profile (AGG-02..23), derived from the value-frequency table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlens.functions import security, text
from rowlens.operators.cells import top_values, value_frequencies, vf_number, vf_text
from rowlens.operators.joins import skew_safe_join
from rowlens.operators.quantiles import exact_percentiles
from rowlens.operators.table import ColumnRef, Table
from rowlens.sources.rownum import ROW_NUMBER
from rowlens.sources.scratch import materialize

# Thresholds of the profile.
CATEGORICAL_RATIO = 0.5
IDENTIFIER_MIN_VALUES = 2
HIGH_CARDINALITY_RATIO = 0.9
LIKELY_IDENTIFIER_RATIO = 0.98
FENCE_MULTIPLIER = 1.5
TEXT_FAMILY = ("text", "categorical", "identifier")

PROFILE_SCHEMA = (
    "ordinal int, original_name string, internal_key string, inferred_type string, "
    "null_count bigint, non_null_count bigint, distinct_count bigint, uniqueness_ratio double, "
    "source_type string, boolean_matches bigint, date_matches bigint, numeric_matches bigint, "
    "mixed_warning string, "
    "num_min double, num_max double, mean double, median double, stdev double, q1 double, "
    "q2 double, q3 double, iqr double, mad double, zero_count bigint, negative_count bigint, "
    "extreme_count bigint, "
    "date_min string, date_max string, future_date_count bigint, invalid_parse_count bigint, "
    "max_gap_days int, "
    "min_length int, max_length int, whitespace_issue_count bigint, empty_string_count bigint, "
    "normalized_distinct_count bigint, high_cardinality boolean, likely_identifier boolean, "
    "instruction_like_value_count bigint"
)


def infer_type(total: int, distinct: int, booleans: int, dates: int, numbers: int) -> str:
    """AGG-03, the precedence chain over the four counts of one column."""
    if total == 0:
        return "unknown"
    if booleans == total:
        return "boolean"
    if dates == total:
        return "date"
    if numbers == total:
        return "numeric"
    if booleans or dates or numbers:
        return "mixed"
    if total >= IDENTIFIER_MIN_VALUES and distinct == total:
        return "identifier"
    return "categorical" if distinct / total <= CATEGORICAL_RATIO else "text"


def mixed_warning(booleans: int, dates: int, numbers: int, total: int) -> str:
    """AGG-04."""
    return (
        f"Column has a mix of value shapes: {booleans} boolean-like, {dates} date-like, "
        f"{numbers} numeric-like, out of {total} non-blank values"
    )


def readable(vf: DataFrame) -> DataFrame:
    """The frequency table with `v`, the number each value stands for, worked out once."""
    return vf if "v" in vf.columns else vf.withColumn("v", vf_number())


def type_counts(vf: DataFrame) -> DataFrame:
    """AGG-02/03 inputs and the plain numeric sums of every column, in one pass."""
    n, value, v = F.col("n"), F.col("value"), F.col("v")
    return readable(vf).groupBy("ordinal").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("distinct"),
        F.sum(F.when(text.is_boolean(value), n).otherwise(0)).alias("booleans"),
        F.sum(F.when(text.is_iso_date(value), n).otherwise(0)).alias("dates"),
        F.sum(F.when(v.isNotNull(), n).otherwise(0)).alias("numbers"),
        F.sum(F.octet_length(vf_text()).cast("long") * n).alias("bytes"),
        F.min("v").alias("num_min"),
        F.max("v").alias("num_max"),
        F.sum(v * n).alias("weighted"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("zero_count"),
        F.sum(F.when(v < 0, n).otherwise(0)).alias("negative_count"),
    )


@dataclass
class Profile:
    """The profile of one table. Column rows are metadata, at most one per column."""

    table: Table
    vf: DataFrame
    as_of: dt.date
    columns: list[dict]
    memory_estimate_bytes: int

    @property
    def row_count(self) -> int:
        return self.table.row_count

    def by_ordinal(self, ordinal: int) -> dict:
        return self.columns[ordinal]

    def of_type(self, *types: str) -> list[tuple[ColumnRef, dict]]:
        return [
            (ref, p)
            for ref, p in zip(self.table.columns, self.columns, strict=True)
            if p["inferred_type"] in types
        ]

    def vf_of(self, columns: list[ColumnRef]) -> DataFrame:
        return self.vf.where(F.col("ordinal").isin([c.ordinal for c in columns]))

    @cached_property
    def column_profile(self) -> DataFrame:
        names = [f.strip().split(" ")[0] for f in PROFILE_SCHEMA.split(",")]
        return self.table.spark.createDataFrame(
            [tuple(p.get(name) for name in names) for p in self.columns], PROFILE_SCHEMA
        )

    @cached_property
    def representative_values(self) -> DataFrame:
        return top_values(self.vf)

    @cached_property
    def wide_counts(self) -> dict:
        """Whole-row counts (AGG-20/21) from the wide table."""
        missing_everywhere = text.all_of([self.table.missing(c) for c in self.table.columns])
        empty = self.table.df.agg(F.count_if(missing_everywhere).alias("n")).first()["n"]
        extra = (
            duplicate_groups(self.table)
            .agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n"))
            .first()["n"]
        )
        return {"duplicate_row_count": extra, "empty_row_count": empty}

    @cached_property
    def dataset_profile(self) -> DataFrame:
        """AGG-18..22, one row."""
        row = (
            self.row_count,
            len(self.columns),
            self.memory_estimate_bytes,
            self.wide_counts["duplicate_row_count"],
            self.wide_counts["empty_row_count"],
            sum(p["inferred_type"] == "unknown" for p in self.columns),
        )
        return self.table.spark.createDataFrame(
            [row],
            "row_count bigint, column_count int, memory_estimate_bytes bigint, "
            "duplicate_row_count bigint, empty_row_count bigint, empty_column_count int",
        )


def _duplicate_candidates(table: Table) -> tuple[DataFrame, list[str]]:
    """Rows whose 64-bit row hash occurs more than once; only hashes are shuffled to find them."""
    fields = [c.field for c in table.columns]
    hashed = table.df.select(ROW_NUMBER, *fields, F.xxhash64(*fields).alias("_hash"))
    repeated = materialize(
        hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > 1),
        "hashes",
    )
    return (
        skew_safe_join(hashed, repeated, ["_hash"], "_copies", table.row_count).drop("_copies"),
        fields,
    )


def _duplicates(table: Table) -> tuple[DataFrame, DataFrame, list[str]]:
    """(candidate rows, exact groups, fields), each written once per table."""
    if "duplicates" not in table.stored:
        candidates, fields = _duplicate_candidates(table)
        candidates = materialize(candidates, "candidates")
        groups = materialize(
            candidates.groupBy("_hash", *fields)
            .agg(F.count(F.lit(1)).alias("copies"), F.min(ROW_NUMBER).alias("first_row"))
            .where(F.col("copies") > 1),
            "copies",
        )
        table.stored["duplicates"] = (candidates, groups, fields)
    return table.stored["duplicates"]


def duplicate_groups(table: Table) -> DataFrame:
    """AGG-20 / DET-01: exact full-row groups with more than one member."""
    return _duplicates(table)[1]


def duplicate_members(table: Table) -> DataFrame:
    """Every row of every duplicate group."""
    candidates, groups, fields = _duplicates(table)
    return skew_safe_join(
        candidates, groups.drop("first_row"), ["_hash", *fields], "copies", table.row_count
    ).select(ROW_NUMBER, "copies")


def _date_gaps(vf: DataFrame) -> DataFrame:
    """AGG-13. Distinct calendar days per column number at most about 3.65 million."""
    days = vf.select("ordinal", text.iso_date(F.col("value")).alias("day")).distinct()
    previous = F.lag("day").over(W.partitionBy("ordinal").orderBy("day"))
    return days.select("ordinal", F.datediff("day", previous).alias("gap")).groupBy("ordinal").agg(
        F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_days")
    )


def _numeric_metrics(vf: DataFrame, counts: dict) -> dict[int, dict]:
    """AGG-07..11: three passes over the distinct numbers, after the sums of the type pass."""
    v = vf.select("ordinal", "v", "n")
    n = F.col("n")
    sizes = {o: (c.total, c.distinct) for o, c in counts.items()}
    quartiles = exact_percentiles(v, [0.25, 0.5, 0.75], sizes=sizes)
    iqr = {o: q[2] - q[0] for o, q in quartiles.items()}
    mean = {o: counts[o].weighted / counts[o].total for o in quartiles}
    # one row per numeric column
    constants = F.broadcast(
        vf.sparkSession.createDataFrame(
            [
                (
                    o, float(mean[o]), q[1],
                    q[0] - FENCE_MULTIPLIER * iqr[o], q[2] + FENCE_MULTIPLIER * iqr[o],
                )
                for o, q in quartiles.items()
            ],
            "ordinal int, mean double, median double, low double, high double",
        )
    )
    placed = v.join(constants, "ordinal")
    outside = (F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))
    deviation = F.abs(F.col("v") - F.col("median"))
    aggregates = [
        F.sum(n * F.pow(F.col("v") - F.col("mean"), 2)).alias("ss"),
        F.sum(F.when(outside & ~F.isnan("v"), n).otherwise(0)).alias("extreme_count"),
    ]
    spread = {r.ordinal: r for r in placed.groupBy("ordinal").agg(*aggregates).collect()}
    mad = exact_percentiles(placed.select("ordinal", deviation.alias("v"), "n"), [0.5], sizes=sizes)
    out = {}
    for o, (q1, q2, q3) in quartiles.items():
        c, total = counts[o], counts[o].total
        out[o] = {
            "num_min": c.num_min, "num_max": c.num_max, "mean": mean[o],
            "zero_count": c.zero_count, "negative_count": c.negative_count,
            "median": q2, "q1": q1, "q2": q2, "q3": q3, "iqr": iqr[o], "mad": mad[o][0],
            "stdev": (spread[o].ss / (total - 1)) ** 0.5 if total >= 2 else 0.0,
            "extreme_count": spread[o].extreme_count,
        }
    return out


def _date_metrics(vf: DataFrame, as_of: dt.date) -> dict[int, dict]:
    """AGG-12/13."""
    day = text.iso_date(F.col("value"))
    basics = (
        vf.groupBy("ordinal")
        .agg(
            F.min(day).cast("string").alias("date_min"),
            F.max(day).cast("string").alias("date_max"),
            F.sum(F.when(day > F.lit(as_of), F.col("n")).otherwise(0)).alias("future_date_count"),
        )
        .join(_date_gaps(vf), "ordinal")
        .collect()
    )
    return {
        r.ordinal: {
            "date_min": r.date_min,
            "date_max": r.date_max,
            "future_date_count": r.future_date_count,
            "max_gap_days": r.max_gap_days,
            "invalid_parse_count": 0,
        }
        for r in basics
    }


def _text_metrics(vf: DataFrame) -> dict[int, dict]:
    """AGG-14/15/17."""
    value, n = F.col("value"), F.col("n")
    basics = vf.groupBy("ordinal").agg(
        F.min(F.length(value)).alias("min_length"),
        F.max(F.length(value)).alias("max_length"),
        F.sum(F.when(value != text.strip(value), n).otherwise(0)).alias("whitespace_issue_count"),
        F.sum(F.when(text.strip(value) == "", n).otherwise(0)).alias("empty_string_count"),
        F.sum(F.when(security.instruction_like(value), n).otherwise(0)).alias(
            "instruction_like_value_count"
        ),
    )
    normalized = (
        vf.select("ordinal", text.casing_key(value).alias("key"))
        .distinct()
        .groupBy("ordinal")
        .agg(F.count(F.lit(1)).alias("normalized_distinct_count"))
    )
    return {r.ordinal: r.asDict() for r in basics.join(normalized, "ordinal").collect()}


def compute_profile(
    table: Table, as_of: dt.date | None = None, vf: DataFrame | None = None
) -> Profile:
    """AGG-23. The frequency table is written once; every metric reads only the columns it needs."""
    as_of = as_of or dt.date.today()
    if vf is None:
        # sorted by column, so that a later read of some columns skips the others' row groups
        vf = materialize(readable(value_frequencies(table)).sortWithinPartitions("ordinal"), "vf")
    vf = readable(vf)
    counts = {r.ordinal: r for r in type_counts(vf).collect()}
    columns = []
    for ref in table.columns:
        c = counts.get(ref.ordinal)
        total, distinct = (c.total, c.distinct) if c else (0, 0)
        booleans, dates, numbers = (c.booleans, c.dates, c.numbers) if c else (0, 0, 0)
        kind = infer_type(total, distinct, booleans, dates, numbers)
        columns.append(
            {
                "ordinal": ref.ordinal,
                "original_name": ref.original_name,
                "internal_key": ref.internal_key,
                "inferred_type": kind,
                "null_count": table.row_count - total,
                "non_null_count": total,
                "distinct_count": distinct,
                "uniqueness_ratio": distinct / total if total else 0.0,
                "source_type": "string" if ref.kind == "text" else ref.kind,
                "boolean_matches": booleans,
                "date_matches": dates,
                "numeric_matches": numbers,
                "mixed_warning": mixed_warning(booleans, dates, numbers, total)
                if kind == "mixed"
                else None,
            }
        )
    profile = Profile(table, vf, as_of, columns, sum(c.bytes for c in counts.values()))

    def fill(types: tuple[str, ...], metrics) -> None:
        refs = [ref for ref, _ in profile.of_type(*types)]
        if refs:
            for ordinal, values in metrics(profile.vf_of(refs)).items():
                columns[ordinal].update(values)

    fill(
        ("numeric",),
        lambda f: _numeric_metrics(f, {o: counts[o] for o in (r.ordinal for r, _ in profile.of_type("numeric"))}),
    )
    fill(("date",), lambda f: _date_metrics(f, as_of))
    fill(TEXT_FAMILY, _text_metrics)
    for _, p in profile.of_type(*TEXT_FAMILY):
        ratio = p["uniqueness_ratio"]
        p["high_cardinality"] = ratio >= HIGH_CARDINALITY_RATIO
        p["likely_identifier"] = (
            ratio >= LIKELY_IDENTIFIER_RATIO and p["non_null_count"] >= IDENTIFIER_MIN_VALUES
        )
    return profile
