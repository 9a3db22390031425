"""The detector catalogue and its runner (DET-27)."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.operators.detectors import groups, observations, structural, values
from rowlens.operators.detectors.base import FINDING_SCHEMA, Context, Detector, Outcome
from rowlens.sources.rownum import ROW_NUMBER, number_rows
from rowlens.sources.scratch import materialize

CATALOGUE: tuple[Detector, ...] = (
    structural.EXACT_DUPLICATE_ROWS,
    structural.EMPTY_COLUMN,
    values.MISSING_VALUES,
    values.MISSING_IDENTIFIER,
    groups.CAPITALIZATION,
    values.EDGE_WHITESPACE,
    values.FUTURE_DATES,
    values.NEGATIVES,
    values.PERCENTAGES,
    values.LINE_TOTAL,
    values.CONSTANT,
    values.OUTLIERS,
    values.INJECTION,
    structural.FULLY_EMPTY_ROWS,
    values.BOOLEANS,
    values.OLD_DATES,
    values.EMAILS,
    values.NUMBERS_AS_TEXT,
    groups.NEAR_DUPLICATES,
    structural.DUPLICATE_NAMES,
    structural.EMPTY_DATASET,
    structural.UNNAMED_COLUMN,
    structural.PARSE_FAILURES,
    observations.MIXED_TYPES,
    observations.DATE_FORMATS,
    observations.CONCENTRATED_MISSING,
)
BY_ID = {d.id: d for d in CATALOGUE}
CONCURRENT_DETECTORS = 6
RANK = {d.id: i for i, d in enumerate(CATALOGUE)}
FINDING_ORDER = ["detector_rank", "first_ordinal", "group_position", "group_text"]


@dataclass
class Detection:
    """All detector results of one table, as tables."""

    ctx: Context
    runs: list[dict]
    outcomes: list[Outcome] = field(default_factory=list)

    @property
    def spark(self):
        return self.ctx.table.spark

    def _all(self, name: str) -> list:
        return [x for o in self.outcomes for x in getattr(o, name)]

    @cached_property
    def detector_runs(self) -> DataFrame:
        return self.spark.createDataFrame(
            [
                (r["detector_id"], r["version"], r["status"], r["warning"], r["error"], r["duration_ms"])
                for r in self.runs
            ],
            "detector_id string, version string, status string, warning string, error string, "
            "duration_ms int",
        )

    @cached_property
    def findings(self) -> DataFrame:
        """One row per finding, with its index in catalogue, column and group order."""
        names = [f.strip().split(" ")[0] for f in FINDING_SCHEMA.split(",")]
        local = [
            {**f, "detector_rank": RANK[f["detector_id"]]} for f in self._all("findings")
        ]
        frames = [
            f.withColumn("detector_rank", F.lit(RANK[d])).select(*names)
            for d, f in self._frames()
        ]
        if not frames:
            local.sort(key=lambda f: tuple(f[k] for k in FINDING_ORDER))
            return self.spark.createDataFrame(
                [(i, *(f[n] for n in names)) for i, f in enumerate(local)],
                "finding_index bigint, " + FINDING_SCHEMA,
            )
        frames.append(
            self.spark.createDataFrame([tuple(f[n] for n in names) for f in local], FINDING_SCHEMA)
        )
        combined = reduce(DataFrame.unionByName, frames)
        return materialize(
            number_rows(combined, FINDING_ORDER).withColumnRenamed(ROW_NUMBER, "finding_index"),
            "findings",
        ).select("finding_index", *names)

    def _frames(self) -> list[tuple[str, DataFrame]]:
        return [
            (d, f)
            for d, o in zip([r["detector_id"] for r in self.runs if r["ran"]], self.outcomes, strict=True)
            for f in o.finding_frames
        ]

    @cached_property
    def finding_columns(self) -> DataFrame:
        """(finding_key, position, ordinal, internal_key, original_name)."""
        listed = self.spark.createDataFrame(
            self._all("finding_columns"), "finding_key string, position int, ordinal int"
        )
        for _, frame in self._frames():
            listed = listed.unionByName(
                frame.select("finding_key", F.lit(0).alias("position"), F.col("first_ordinal").alias("ordinal"))
            )
        return listed.join(self.ctx.table.columns_frame(), "ordinal").select(
            "finding_key", "position", "ordinal", "internal_key", "original_name"
        )

    @cached_property
    def finding_rows(self) -> DataFrame:
        """(finding_key, row_number): one scan for every predicate, plus the grouped ones; written once."""
        frames = list(self._all("row_frames"))
        flags = self._all("flags")
        if flags:
            marks = F.array_compact(
                F.array(*[F.when(predicate, F.lit(key)) for key, predicate in flags])
            )
            # explode drops rows without a mark; the marks are evaluated once per row
            frames.append(
                self.ctx.table.df.select(F.explode(marks).alias("finding_key"), ROW_NUMBER)
            )
        if not frames:
            return self.spark.createDataFrame([], f"finding_key string, {ROW_NUMBER} bigint")
        return materialize(reduce(DataFrame.unionByName, frames), "finding-rows")

    @cached_property
    def finding_values(self) -> DataFrame:
        """(finding_key, value): the spellings behind a group finding."""
        frames = self._all("value_frames")
        if not frames:
            return self.spark.createDataFrame([], "finding_key string, value string")
        return reduce(DataFrame.unionByName, frames)

    @cached_property
    def observations(self) -> DataFrame:
        return self.spark.createDataFrame(
            [
                (o["observation_key"], o["detector_id"], o["ordinal"], o["summary"], o["payload"])
                for o in self._all("observations")
            ],
            "observation_key string, detector_id string, ordinal int, summary string, payload string",
        )

    @cached_property
    def observation_rows(self) -> DataFrame:
        """(observation_key, ordinal, row_number): at most 20 example rows each."""
        return self.spark.createDataFrame(
            [
                (o["observation_key"], o["ordinal"], r)
                for o in self._all("observations")
                for r in o["example_rows"]
            ],
            f"observation_key string, ordinal int, {ROW_NUMBER} bigint",
        )

    @cached_property
    def evidence(self) -> DataFrame:
        """One evidence row per finding, keyed like the finding."""
        return self.findings.select(
            F.concat(F.col("finding_key"), F.lit(".evidence")).alias("evidence_id"),
            "finding_key",
            "payload",
        )


def run_detectors(
    ctx: Context,
    detectors: tuple[Detector, ...] = CATALOGUE,
    config: dict[str, dict] | None = None,
) -> Detection:
    """DET-27: input gating, merged and checked configuration, isolated failures, timing."""
    def attempt(d: Detector) -> tuple[dict, Outcome | None]:
        record = {
            "detector_id": d.id, "version": d.version, "status": "success", "warning": None,
            "error": None, "duration_ms": 0, "ran": False,
        }
        if d.needs_facts and ctx.facts is None:
            record.update(status="skipped", warning="detector.skipped_ingest_facts_absent")
            return record, None
        merged = {**d.defaults, **(config or {}).get(d.id, {})}
        started = time.perf_counter()
        outcome = None
        try:
            unknown = set(merged) - set(d.defaults)
            if unknown:
                raise ValueError(f"unknown configuration: {sorted(unknown)}")
            if d.check:
                d.check(merged)
            outcome = d.run(ctx, merged)
        except Exception as error:  # one detector's failure never stops the others
            record.update(status="failed", error=type(error).__name__)
        else:
            record.update(
                ran=True, warning=outcome.warnings[0][0] if outcome.warnings else None
            )
        record["duration_ms"] = round((time.perf_counter() - started) * 1000)
        return record, outcome

    # Most detectors are one small job, so several are submitted at a time.
    with ThreadPoolExecutor(CONCURRENT_DETECTORS) as pool:
        results = list(pool.map(inheritable_thread_target(ctx.table.spark)(attempt), detectors))
    return Detection(ctx, [r for r, _ in results], [o for _, o in results if o is not None])
