"""Stored runs, rules and reviews (SNK-04, RUL-19/20): append-only tables with a commit record.

Every change is an operation with an id of its own. Its rows go to a new folder of each table
first; one commit record then names that folder. Readers take only what a record names, so rows of
an operation that broke off are never seen, and an operation that is tried again adds nothing.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.operators import findings as fnd
from rowlens.operators import rules as rul
from rowlens.operators.rules import Rule
from rowlens.operators.table import Table
from rowlens.plans.analysis import Analysis
from rowlens.sources.rownum import ROW_NUMBER, broadcast_if_small

COMMIT_SCHEMA = "analysis_id string, operation_id string, kind string, attempt string, tables array<string>, committed_at timestamp"
RUN_SCHEMA = (
    "analysis_id string, state string, original_filename string, dataset_format string, byte_size bigint, "
    "content_sha256 string, created_at timestamp"
)
RULE_SCHEMA = "analysis_id string, rule_id string, name string, provenance string, definition string, created_at timestamp"
RESULT_SCHEMA = f"analysis_id string, operation_id string, executed_at timestamp, {rul.RESULT_SCHEMA}"
REVIEW_SCHEMA = "finding_key string, review_state string, note string, dismissal_reason string, reviewed_at timestamp"


def rule_text(rule: Rule) -> str:
    """A rule as JSON, without what is unset."""
    given = {k: v for k, v in dataclasses.asdict(rule).items() if v is not None}
    return json.dumps(given, default=lambda v: v.isoformat(), sort_keys=True)


def rule_from(definition: str) -> Rule:
    given = json.loads(definition)
    for name in ("columns", "accepted_values", "source_finding_ids"):
        if name in given:
            given[name] = tuple(given[name])
    for name in ("minimum_date", "maximum_date"):
        if name in given:
            given[name] = dt.date.fromisoformat(given[name])
    return Rule(**given)


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


class RunStore:
    """The stored results under one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- operations -----------------------------------------------------------------------------

    def commits(self) -> DataFrame:
        """One record per finished operation; of two that ran at once, one counts."""
        try:
            every = self.spark.read.schema(COMMIT_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.root}/_commits")
        except AnalysisException:
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        first = F.min_by(F.struct("kind", "attempt", "tables", "committed_at"), F.struct("committed_at", "attempt"))
        return every.groupBy("analysis_id", "operation_id").agg(first.alias("c")).select("analysis_id", "operation_id", "c.*")

    def committed(self, analysis_id: str, operation_id: str) -> bool:
        return not self.commits().where((F.col("analysis_id") == analysis_id) & (F.col("operation_id") == operation_id)).isEmpty()

    def commit(
        self, analysis_id: str, operation_id: str, kind: str, tables: dict[str, DataFrame], at: dt.datetime | None = None
    ) -> bool:
        """Writes `tables` and then the record; False, and nothing new to read, if it is there already."""
        if self.committed(analysis_id, operation_id):
            return False
        attempt = f"a-{uuid.uuid4().hex}"
        for name, frame in tables.items():
            frame.write.parquet(f"{self.root}/{name}/attempt={attempt}")
        record = [(analysis_id, operation_id, kind, attempt, sorted(tables), at or _now())]
        place = hashlib.sha256(json.dumps([analysis_id, operation_id]).encode()).hexdigest()
        try:
            self.spark.createDataFrame(record, COMMIT_SCHEMA).coalesce(1).write.parquet(f"{self.root}/_commits/{place}")
        except AnalysisException:  # another try has committed meanwhile
            if not self.committed(analysis_id, operation_id):
                raise
            return False
        return True

    def read(self, name: str, schema: str | T.StructType, analysis_id: str | None = None) -> DataFrame:
        """The committed rows of a table; folders of other runs and of broken tries are not read."""
        commits = self.commits().where(F.array_contains("tables", name))
        if analysis_id is not None:
            commits = commits.where(F.col("analysis_id") == analysis_id)
        if commits.isEmpty():
            return self.spark.createDataFrame([], schema)
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        stored = self.spark.read.schema(T.StructType([*wanted.fields, T.StructField("attempt", T.StringType())])).parquet(f"{self.root}/{name}")
        return stored.join(broadcast_if_small(commits.select("attempt")), "attempt", "left_semi").select(*wanted.fieldNames())

    # --- runs -----------------------------------------------------------------------------------

    def add(
        self, done: Analysis, *, original_filename: str, dataset_format: str, byte_size: int = 0, content_sha256: str = "",
        operation_id: str = "analysis", created_at: dt.datetime | None = None,
    ) -> bool:
        """SNK-04: the run's row and all its result tables, in one operation."""
        own = F.lit(done.analysis_id).alias("analysis_id")
        tables = {name: frame.select(own, *[c for c in frame.columns if c != "analysis_id"]) for name, frame in done.tables().items()}
        at = created_at or _now()
        row = (done.analysis_id, "completed", original_filename, dataset_format, byte_size, content_sha256, at)
        tables["runs"] = self.spark.createDataFrame([row], RUN_SCHEMA)
        return self.commit(done.analysis_id, operation_id, "analysis", tables, at)

    def result(self, name: str, analysis_id: str | None = None) -> DataFrame:
        """A stored result table of `Analysis.tables`, with the columns it was written with."""
        commits = self.commits().where((F.col("kind") == "analysis") & F.array_contains("tables", name))
        known = commits.select("attempt").limit(1).collect()
        if not known:
            raise ValueError(f"no run has stored {name!r}")
        written = self.spark.read.parquet(f"{self.root}/{name}/attempt={known[0]['attempt']}").schema
        return self.read(name, written, analysis_id)

    def runs(self) -> DataFrame:
        """The stored runs as HIS-01..04 read them: trust label and number of findings included."""
        rows = self.read("runs", RUN_SCHEMA)
        if self.commits().where("kind = 'analysis'").isEmpty():
            return rows.withColumns({"trust_label": F.lit(None).cast("string"), "finding_count": F.lit(None).cast("bigint")})
        trust = self.result("trust_assessment").select("analysis_id", F.col("label").alias("trust_label"), "finding_count")
        return rows.join(trust, "analysis_id", "left")

    def _require(self, analysis_id: str) -> None:
        if self.commits().where((F.col("analysis_id") == analysis_id) & (F.col("kind") == "analysis")).isEmpty():
            raise ValueError(f"no completed analysis {analysis_id!r}")

    # --- rules ----------------------------------------------------------------------------------

    def create_rule(
        self, analysis_id: str, table: Table, rule: Rule, *, source_finding: str | None = None, operation_id: str | None = None,
        at: dt.datetime | None = None,
    ) -> Rule:
        """RUL-19: checks the rule, decides its provenance, runs it over all rows and stores both.

        An unknown column, a shape that is not valid, an unknown finding, a false claim and a rule id
        in use are errors, and then nothing is stored.
        """
        operation = operation_id or f"create.{rule.rule_id}"
        if self.committed(analysis_id, operation):
            return self.rule(analysis_id, rule.rule_id)
        self._require(analysis_id)
        if rule.problem():
            raise ValueError(rule.problem())
        rul.resolve(table, rule)
        if not self._rules(analysis_id).where(F.col("rule_id") == rule.rule_id).isEmpty():
            raise ValueError(f"there is a rule {rule.rule_id!r} already")
        detector, candidates = None, ()
        if source_finding is not None:
            mine = self.result("findings", analysis_id).where(F.col("finding_key") == source_finding)
            found = mine.select("detector_id").first()
            if found is None:
                raise ValueError(f"unknown finding {source_finding!r}")
            detector = found["detector_id"]
            if detector == rul.CHOICE_DETECTOR and rule.accepted_values is not None and len(rule.accepted_values) == 1:
                spellings = rul.casing_candidates(mine, self.result("finding_values", analysis_id))
                candidates = tuple(r["value"] for r in spellings.where(F.col("value") == rule.accepted_values[0]).limit(1).collect())
        rule = dataclasses.replace(
            rule, provenance=rul.provenance_of(rule, detector, candidates),
            source_finding_ids=(source_finding,) if source_finding is not None else (),
        )
        at = at or _now()
        row = (analysis_id, rule.rule_id, rule.name, rule.provenance, rule_text(rule), at)
        tables = {"rules": self.spark.createDataFrame([row], RULE_SCHEMA), **self._executed(analysis_id, operation, table, rule, at)}
        self.commit(analysis_id, operation, "rule", tables, at)
        return rule

    def rerun_rule(
        self, analysis_id: str, table: Table, rule_id: str, *, operation_id: str | None = None, at: dt.datetime | None = None
    ) -> bool:
        """RUL-20: runs a stored rule over the rows as they are now and appends the result."""
        self._require(analysis_id)
        operation = operation_id or f"run.{uuid.uuid4().hex}"
        if self.committed(analysis_id, operation):
            return False
        at = at or _now()
        tables = self._executed(analysis_id, operation, table, self.rule(analysis_id, rule_id), at)
        return self.commit(analysis_id, operation, "rule_run", tables, at)

    def _executed(self, analysis_id: str, operation: str, table: Table, rule: Rule, at: dt.datetime) -> dict[str, DataFrame]:
        run = rul.execute_rules(table, [rule])
        own = [F.lit(analysis_id).alias("analysis_id"), F.lit(operation).alias("operation_id")]
        return {
            "rule_results": run.results.select(*own, F.lit(at).cast("timestamp").alias("executed_at"), "*"),
            "rule_failures": run.failures.select(*own, "*"),
        }

    def _rules(self, analysis_id: str | None) -> DataFrame:
        return self.read("rules", RULE_SCHEMA, analysis_id)

    def rule(self, analysis_id: str, rule_id: str) -> Rule:
        found = self._rules(analysis_id).where(F.col("rule_id") == rule_id).first()
        if found is None:
            raise ValueError(f"unknown rule {rule_id!r}")
        return rule_from(found["definition"])

    def rule_results(self, analysis_id: str | None = None) -> DataFrame:
        """Every stored execution."""
        return self.read("rule_results", RESULT_SCHEMA, analysis_id)

    def rules(self, analysis_id: str | None = None) -> DataFrame:
        """Stored rules with their latest result; of two at one time the larger operation id counts."""
        order = W.partitionBy("analysis_id", "rule_id").orderBy(F.desc("executed_at"), F.desc("operation_id"))
        latest = self.rule_results(analysis_id).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        return self._rules(analysis_id).join(latest, ["analysis_id", "rule_id"], "left")

    def latest_failures(self, analysis_id: str | None = None) -> DataFrame:
        """The kept failing rows of every rule's latest execution."""
        stored = self.read("rule_failures", f"analysis_id string, operation_id string, {rul.FAILURE_SCHEMA}", analysis_id)
        latest = self.rules(analysis_id).select("analysis_id", "operation_id", "rule_id")
        return stored.join(latest, ["analysis_id", "operation_id", "rule_id"]).select("analysis_id", "rule_id", "position", ROW_NUMBER, "reason")

    # --- reviews --------------------------------------------------------------------------------

    def add_reviews(self, analysis_id: str, reviews: DataFrame, operation_id: str, at: dt.datetime | None = None) -> bool:
        """Review decisions (finding_key, review_state, note, dismissal_reason, reviewed_at)."""
        self._require(analysis_id)
        names = T.StructType.fromDDL(REVIEW_SCHEMA).fieldNames()
        return self.commit(
            analysis_id, operation_id, "review", {"reviews": reviews.select(F.lit(analysis_id).alias("analysis_id"), *names)}, at
        )

    def reviewed_findings(self, analysis_id: str) -> DataFrame:
        """Stored findings with their latest review decision."""
        reviews = self.read("reviews", f"analysis_id string, {REVIEW_SCHEMA}", analysis_id).drop("analysis_id")
        return fnd.with_review_state(self.result("findings", analysis_id), reviews)
