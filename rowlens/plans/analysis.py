"""One analysis end to end: table -> profile -> detectors -> scores -> stored tables (SNK-04)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.operators import findings as fnd
from rowlens.operators.context import consolidate, guided_questions, hypotheses
from rowlens.operators.detectors import CATALOGUE, Context, Detection, Detector, run_detectors
from rowlens.operators.profile import Profile, compute_profile
from rowlens.operators.table import Table


@dataclass
class Analysis:
    """Result tables of one run; each is built when it is first asked for."""

    analysis_id: str
    table: Table
    profile: Profile
    detection: Detection
    samples_sent: bool = False

    @cached_property
    def findings(self) -> DataFrame:
        return fnd.priority_scores(
            self.detection.findings,
            self.detection.finding_columns,
            self.profile.column_profile,
            self.table.row_count,
        )

    @cached_property
    def trust(self) -> DataFrame:
        return fnd.trust_assessment(self.findings, self.detection.finding_columns, self.samples_sent)

    @cached_property
    def hypotheses(self) -> DataFrame:
        return hypotheses(self.profile.column_profile)

    @cached_property
    def context(self) -> DataFrame:
        return consolidate(self.hypotheses)

    @cached_property
    def questions(self) -> DataFrame:
        return guided_questions(self.context)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "column_profile": self.profile.column_profile,
            "dataset_profile": self.profile.dataset_profile,
            "representative_values": self.profile.representative_values,
            "findings": self.findings,
            "finding_columns": self.detection.finding_columns,
            "finding_rows": self.detection.finding_rows,
            "finding_values": self.detection.finding_values,
            "evidence": self.detection.evidence,
            "observations": self.detection.observations,
            "observation_rows": self.detection.observation_rows,
            "detector_runs": self.detection.detector_runs,
            "trust_assessment": self.trust,
            "dataset_context": self.context,
        }

    def write(self, root: str, names: list[str] | None = None) -> dict[str, str]:
        """SNK-04: one Parquet table per result, partitioned by run."""
        paths = {}
        for name, frame in self.tables().items():
            if names and name not in names:
                continue
            paths[name] = f"{root.rstrip('/')}/{name}"
            frame.withColumn("analysis_id", F.lit(self.analysis_id)).write.mode("append").partitionBy(
                "analysis_id"
            ).parquet(paths[name])
        return paths


def analyze(
    source: Table | DataFrame,
    *,
    analysis_id: str = "analysis",
    as_of: dt.date | None = None,
    detectors: tuple[Detector, ...] = CATALOGUE,
    config: dict[str, dict] | None = None,
    samples_sent: bool = False,
) -> Analysis:
    """Profile a table, run the detectors and score what they found."""
    table = source if isinstance(source, Table) else Table.from_dataframe(source)
    profile = compute_profile(table, as_of)
    detection = run_detectors(Context(profile, samples_sent=samples_sent), detectors, config)
    return Analysis(analysis_id, table, profile, detection, samples_sent)
