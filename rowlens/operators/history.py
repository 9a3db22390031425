"""Run history, relationship log and call counters (HIS-01..08)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# List sizes and version limits.
DEFAULT_LIMIT = 20
MAX_LIMIT = 50
MAX_ACTIVE_RELATIONSHIPS = 50
MAX_VERSIONS_PER_RELATIONSHIP = 50
MAX_VERSIONS_PER_ANALYSIS = 500

SUMMARY_COLUMNS = (
    "analysis_id", "state", "original_filename", "dataset_format", "byte_size",
    "created_at", "trust_label", "finding_count",
)


def summaries(runs: DataFrame) -> DataFrame:
    """HIS-04: the content-free view of stored runs."""
    return runs.select(*SUMMARY_COLUMNS)


def recent(runs: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """HIS-01: newest first (a top-k report)."""
    return summaries(runs).orderBy(F.desc("created_at"), "analysis_id").limit(
        max(0, min(limit, MAX_LIMIT))
    )


def completed_with_content(runs: DataFrame, content_sha256: str | Column, limit: int = MAX_LIMIT) -> DataFrame:
    """HIS-02."""
    same = (F.col("content_sha256") == content_sha256) & (F.col("state") == "completed")
    return recent(runs.where(same), limit)


def seen_before(runs: DataFrame, content_sha256: str, filename: str) -> DataFrame:
    """HIS-03: at most one row; identical bytes win over an equal name among the latest runs."""

    def notice(frame: DataFrame, kind: str, rank: int) -> DataFrame:
        return frame.agg(
            F.count(F.lit(1)).alias("matches"),
            F.min_by("analysis_id", F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), "analysis_id")).alias("latest"),
        ).where(F.col("matches") > 0).select(
            F.lit(kind).alias("kind"), "matches", "latest", F.lit(rank).alias("_rank")
        )

    exact = notice(completed_with_content(runs, content_sha256), "same_file", 0)
    named = recent(runs, MAX_LIMIT).where(
        (F.col("state") == "completed")
        & (F.lower("original_filename") == F.lower(F.lit(filename)))
    )
    return exact.unionByName(notice(named, "same_name", 1)).orderBy("_rank").limit(1).drop("_rank")


def relationship_views(versions: DataFrame) -> DataFrame:
    """HIS-05: the current version of every relationship and how many it has had."""
    current = F.struct("transition", "kind", "start_key", "end_key", "version")
    return (
        versions.groupBy("analysis_id", "relationship_id")
        .agg(F.max_by(current, "version").alias("c"), F.count(F.lit(1)).alias("versions"))
        .select(
            "analysis_id",
            "relationship_id",
            "c.*",
            "versions",
            F.when(F.col("c.transition") == "withdraw", "withdrawn").otherwise("active").alias("state"),
        )
    )


def relationship_history(versions: DataFrame) -> DataFrame:
    """HIS-05: every version with its state, to be read in version order."""
    return versions.withColumn(
        "state", F.when(F.col("transition") == "withdraw", "withdrawn").otherwise("active")
    )


def active_relationships(versions: DataFrame) -> DataFrame:
    """HIS-06."""
    return (
        relationship_views(versions)
        .groupBy("analysis_id")
        .agg(F.count_if(F.col("state") == "active").alias("active_count"))
    )


DECISION_SCHEMA = (
    "analysis_id string, seq bigint, relationship_id string, version int, transition string, "
    "start_key string, end_key string, outcome string"
)


def _shape_ok() -> Column:
    target = F.col("relationship_id").isNotNull() & F.col("expected_version").isNotNull()
    no_target = F.col("relationship_id").isNull() & F.col("expected_version").isNull()
    roles = F.col("start_key").isNotNull() & F.col("end_key").isNotNull()
    no_roles = F.col("start_key").isNull() & F.col("end_key").isNull()
    return (
        F.when(F.col("transition") == "confirm", no_target & roles)
        .when(F.col("transition") == "replace", target & roles)
        .otherwise(target & no_roles)
    )


def decide_transitions(requests: DataFrame) -> DataFrame:
    """HIS-07: replay a request log, one decision per request.

    `requests(analysis_id, seq, transition, kind, relationship_id, expected_version, start_key,
    end_key, new_id)`. A decision depends on the ones before it in the same analysis, so each
    analysis is one ordered stream: rows are partitioned by analysis and sorted, and a task reads
    batch after batch holding only the open versions, at most a few hundred by the limits.
    Malformed requests need no history and are decided without it.
    """
    ok = _shape_ok()
    malformed = requests.where(~ok).select(
        "analysis_id",
        "seq",
        F.lit(None).cast("string").alias("relationship_id"),
        F.lit(None).cast("int").alias("version"),
        "transition",
        F.lit(None).cast("string").alias("start_key"),
        F.lit(None).cast("string").alias("end_key"),
        F.lit("INVALID_RELATIONSHIP_TRANSITION").alias("outcome"),
    )
    active_cap, history_cap, analysis_cap = (
        MAX_ACTIVE_RELATIONSHIPS, MAX_VERSIONS_PER_RELATIONSHIP, MAX_VERSIONS_PER_ANALYSIS,
    )

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analysis = None
        current: dict[str, list] = {}  # id -> [version, transition, kind, start, end, count]
        total = active = 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.analysis_id != analysis:
                    analysis, current, total, active = r.analysis_id, {}, 0, 0
                row = [r.analysis_id, r.seq, None, None, r.transition, None, None]
                if r.transition == "confirm":
                    if total >= analysis_cap:
                        out.append([*row, "ANALYSIS_RELATIONSHIP_VERSION_LIMIT_REACHED"])
                        continue
                    if active >= active_cap:
                        out.append([*row, "ACTIVE_RELATIONSHIP_LIMIT_REACHED"])
                        continue
                    held = [1, "confirm", r.kind, r.start_key, r.end_key, 1]
                    current[r.new_id] = held
                    active += 1
                    rid = r.new_id
                else:
                    rid = r.relationship_id
                    held = current.get(rid)
                    if held is None:
                        out.append([*row, "RELATIONSHIP_NOT_FOUND"])
                        continue
                    if held[2] != r.kind:
                        out.append([*row, "INVALID_RELATIONSHIP_TRANSITION"])
                        continue
                    if held[1] == "withdraw":
                        out.append([*row, "RELATIONSHIP_WITHDRAWN"])
                        continue
                    if int(r.expected_version) != held[0]:
                        out.append([*row, "RELATIONSHIP_VERSION_CONFLICT"])
                        continue
                    if r.transition == "replace":
                        if held[5] >= history_cap:
                            out.append([*row, "RELATIONSHIP_VERSION_LIMIT_REACHED"])
                            continue
                        if total >= analysis_cap:
                            out.append([*row, "ANALYSIS_RELATIONSHIP_VERSION_LIMIT_REACHED"])
                            continue
                        held[3], held[4] = r.start_key, r.end_key
                    else:
                        active -= 1
                    held[0] += 1
                    held[1] = r.transition
                    held[5] += 1
                total += 1
                out.append([r.analysis_id, r.seq, rid, held[0], r.transition, held[3], held[4], "accepted"])
            yield pd.DataFrame(
                out,
                columns=["analysis_id", "seq", "relationship_id", "version", "transition",
                         "start_key", "end_key", "outcome"],
            )

    ordered = (
        requests.where(ok).repartition("analysis_id").sortWithinPartitions("analysis_id", "seq")
    )
    return ordered.mapInPandas(replay, DECISION_SCHEMA).unionByName(malformed)


def call_counters(calls: DataFrame) -> DataFrame:
    """HIS-08: model-call counters per analysis; flags only turn on, mixed locations are unknown."""
    return calls.groupBy("analysis_id").agg(
        *[
            F.count_if(F.col("outcome") == o).alias(f"{o}_count")
            for o in ("accepted", "rejected", "provider_error")
        ],
        F.bool_or("evidence_sent").alias("evidence_sent"),
        F.bool_or("context_sent").alias("context_sent"),
        F.when(F.min("location") == F.max("location"), F.min("location"))
        .otherwise("unknown")
        .alias("model_location"),
    )
