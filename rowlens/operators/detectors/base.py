"""What a detector sees and what it returns.

Column-level results are metadata (at most one per column) and are built on the driver
from counters one aggregation produced. Results whose number depends on the data (groups
of values, affected rows) are DataFrames and never leave the cluster.
"""

from __future__ import annotations

import datetime as dt
import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from threading import RLock

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlens.functions import security, text
from rowlens.functions.once import where_once
from rowlens.operators.cells import cells
from rowlens.operators.profile import TEXT_FAMILY, Profile
from rowlens.operators.table import ColumnRef
from rowlens.sources.rownum import ROW_NUMBER, broadcast_if_small
from rowlens.sources.scratch import materialize

FINDING_SCHEMA = (
    "finding_key string, detector_id string, detector_rank int, category string, "
    "severity string, confidence double, observation string, first_ordinal int, "
    "group_position bigint, group_text string, affected_row_count bigint, payload string"
)
MAX_EXAMPLE_ROWS = 20


@dataclass
class Outcome:
    findings: list[dict] = field(default_factory=list)
    finding_frames: list[DataFrame] = field(default_factory=list)
    flags: list[tuple[str, Column]] = field(default_factory=list)
    row_frames: list[DataFrame] = field(default_factory=list)
    value_frames: list[DataFrame] = field(default_factory=list)
    finding_columns: list[tuple[str, int, int]] = field(default_factory=list)
    observations: list[dict] = field(default_factory=list)
    warnings: list[tuple[str, str]] = field(default_factory=list)

    def add(
        self,
        detector: Detector,
        columns: list[ColumnRef],
        *,
        severity: str,
        confidence: float,
        observation: str,
        rows: int,
        payload: dict,
        flag: Column | None = None,
    ) -> str:
        key = f"{detector.id}.{columns[0].internal_key if columns else 'table'}"
        self.findings.append(
            {
                "finding_key": key,
                "detector_id": detector.id,
                "category": detector.category,
                "severity": severity,
                "confidence": confidence,
                "observation": observation,
                "first_ordinal": columns[0].ordinal if columns else -1,
                "group_position": 0,
                "group_text": "",
                "affected_row_count": rows,
                "payload": json.dumps(payload),
            }
        )
        self.finding_columns.extend((key, i, c.ordinal) for i, c in enumerate(columns))
        if flag is not None:
            self.flags.append((key, flag))
        return key

    def observe(
        self, detector: Detector, column: ColumnRef, summary: str, payload: dict, rows: list[int]
    ) -> None:
        self.observations.append(
            {
                "observation_key": f"{detector.id}.{column.internal_key}",
                "detector_id": detector.id,
                "ordinal": column.ordinal,
                "summary": summary,
                "payload": json.dumps(payload),
                "example_rows": rows,
            }
        )


@dataclass(frozen=True)
class Detector:
    id: str
    name: str
    category: str
    run: Callable[[Context, dict], Outcome]
    version: str = "1"
    needs_facts: bool = False
    defaults: dict = field(default_factory=dict)
    check: Callable[[dict], None] | None = None


def digest(value: Column) -> Column:
    """SHA-256 in 32 bytes: no two different texts are known to share one."""
    return F.unhex(F.sha2(value, 256))


class Context:
    """Shared inputs of one detector run; shared passes are computed once, on first use."""

    def __init__(self, profile: Profile, *, samples_sent: bool = False):
        self.profile = profile
        self.table = profile.table
        self.samples_sent = samples_sent
        # detectors run side by side; a shared pass runs once
        self._locks = defaultdict(RLock)

    def shared(self, name: str) -> dict[int, dict]:
        with self._locks[name]:
            return getattr(self, name)

    @property
    def facts(self) -> dict | None:
        return self.table.facts

    @property
    def as_of(self) -> dt.date:
        return self.profile.as_of

    def text_values(self, *types: str) -> DataFrame:
        return self.profile.vf_of([ref for ref, _ in self.profile.of_type(*types)])

    @cached_property
    def date_counters(self) -> dict[int, dict]:
        """DET-07/16 counters for every date column in one pass."""
        refs = [ref for ref, _ in self.profile.of_type("date")]
        if not refs:
            return {}
        day, n = text.iso_date(F.col("value")), F.col("n")
        old = day < F.lit(EARLIEST_PLAUSIBLE_DATE)
        rows = self.profile.vf_of(refs).groupBy("ordinal").agg(
            F.sum(F.when(day > F.lit(self.as_of), n).otherwise(0)).alias("future"),
            F.sum(F.when(old, n).otherwise(0)).alias("old"),
            F.min(F.when(old, day)).cast("string").alias("oldest"),
        )
        return {r.ordinal: r.asDict() for r in rows.collect()}

    @cached_property
    def word_counters(self) -> dict[int, dict]:
        """DET-15/17/18 counters for every text-like column in one pass over distinct values."""
        types = (*TEXT_FAMILY, "mixed", "boolean")
        if not self.profile.of_type(*types):
            return {}
        value, n = F.col("value"), F.col("n")
        solid = value != ""
        # the longest word of the vocabulary has five letters
        token = F.when(F.octet_length(value) <= 5, F.lower(value))
        vocabulary = token.isin(*text.BOOLEAN_FAMILIES)
        family = F.create_map(*[F.lit(x) for kv in text.BOOLEAN_FAMILIES.items() for x in kv])
        vocabulary = F.coalesce(vocabulary, F.lit(False))
        kinds = F.col("kinds")

        def total(condition: Column) -> Column:
            return F.sum(F.when(solid & condition, n).otherwise(0))

        stripped = self.text_values(*types).select("ordinal", text.strip(value).alias("value"), "n")
        # each value is read as a number and as an address once, however many counters ask for it
        stripped = stripped.select(
            "*",
            text.has_email_shape(value).alias("email"),
            text.is_decorated_or_plain_number(value).alias("number"),
            text.number_decorations(value).alias("kinds"),
        )
        decorated = F.coalesce(F.size(kinds) > 0, F.lit(False))
        rows = stripped.groupBy("ordinal").agg(
            F.sum(F.when(solid, n).otherwise(0)).alias("checked"),
            F.bool_and(~solid | vocabulary).alias("all_boolean"),
            # at most the vocabulary's families, and its spellings in upper/lower case
            F.collect_set(F.when(solid & vocabulary, F.try_element_at(family, token))).alias(
                "families"
            ),
            F.collect_set(F.when(solid & vocabulary, value)).alias("spellings"),
            total(~F.col("email")).alias("not_email"),
            total(F.col("number")).alias("numeric_like"),
            total(decorated).alias("decorated"),
            *[
                total(F.coalesce(F.array_contains(kinds, k), F.lit(False))).alias(f"d_{i}")
                for i, k in enumerate(DECORATIONS)
            ],
        )
        return {r.ordinal: r.asDict() for r in rows.collect()}

    @cached_property
    def injected_values(self) -> DataFrame:
        """DET-13: the distinct values that match any family, with a digest in place of the value."""
        plain = self.text_values(*TEXT_FAMILY).select(
            "ordinal", "n", "first_row", digest(F.col("value")).alias("digest"), security.normalize(F.col("value")).alias("plain")
        )
        return materialize(where_once(plain, security.any_match(F.col("plain"))), "injected")

    @cached_property
    def injection_counters(self) -> dict[int, dict]:
        """DET-13 counters: families are matched once per distinct value."""
        if not self.profile.of_type(*TEXT_FAMILY):
            return {}
        n, families = F.col("n"), F.col("families")
        # Families are told apart only for the values that match at all.
        matched = self.injected_values.withColumn("families", security.matched_families(F.col("plain"))).withColumn(
            "subtypes", security.subtypes(families)
        )
        rows = matched.groupBy("ordinal").agg(
            F.sum("n").alias("rows"),
            F.min_by("plain", "first_row").alias("first_value"),
            *[F.bool_or(F.array_contains(families, f)).alias(f"f_{f}") for f in security.FAMILIES],
            *[
                F.sum(F.when(F.array_contains("subtypes", s), n).otherwise(0)).alias(f"s_{s}")
                for s in security.SUBTYPES
            ],
        )
        return {
            r.ordinal: r.asDict()
            for r in rows.withColumn("excerpt", security.excerpt(F.col("first_value")))
            .drop("first_value")
            .collect()
        }

    def injected_rows(self, columns: list[ColumnRef]) -> DataFrame:
        """(ordinal, row_number) of the cells that hold a matching value: found by digest, so that no
        text is matched again and none is shuffled."""
        wanted = self.injected_values.where(F.col("ordinal").isin([c.ordinal for c in columns])).select("ordinal", "digest")
        held = cells(self.table, columns).select("ordinal", ROW_NUMBER, digest(F.col("value")).alias("digest"))
        return held.join(broadcast_if_small(wanted), ["ordinal", "digest"], "left_semi").select("ordinal", ROW_NUMBER)

    def first_rows_of(self, conditions: list[Column], limit: int = MAX_EXAMPLE_ROWS) -> list[list[int]]:
        """For each condition its first rows in row order, all from one scan (bounded examples)."""
        if not conditions:
            return []
        marks = F.array_compact(
            F.array(*[F.when(c, F.struct(F.lit(i).alias("condition"))) for i, c in enumerate(conditions)])
        )
        rank = F.row_number().over(W.partitionBy("condition").orderBy(ROW_NUMBER))
        found = self.table.df.select(ROW_NUMBER, F.inline(marks)).withColumn("_rank", rank).where(F.col("_rank") <= limit)
        out: list[list[int]] = [[] for _ in conditions]
        for r in sorted(found.select("condition", ROW_NUMBER).collect()):
            out[r["condition"]].append(r[ROW_NUMBER])
        return out


# Fixed values shared by detectors.
EARLIEST_PLAUSIBLE_DATE = dt.date(1900, 1, 1)
DECORATIONS = ("currency symbol", "percent sign", "thousands separator")


def percent(ratio: float) -> str:
    return f"{ratio:.1%}"
