"""Audit of model answers against known facts (AUD-01..07), as a batch job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The answer schema and the reasons in report order.
SCHEMA_VERSION = "1"
REQUIRED_KEYS = ("schema_version", "narrative", "provenance")
ALLOWED_KEYS = (
    "schema_version", "narrative", "referenced_evidence_ids", "referenced_columns",
    "numeric_claims", "severity", "provenance",
)
SEVERITIES = ("critical", "high", "medium", "low", "informational")
PROVENANCE = "ai_interpretation"
REASONS = (
    "schema_invalid", "unsupported_control_field", "invalid_provenance", "unknown_evidence_id",
    "unknown_column", "unknown_numeric_claim", "numeric_claim_mismatch", "invalid_severity",
)
REASONS_OF_NAMES = ("unknown_evidence_id", "unknown_column", "unknown_numeric_claim", "numeric_claim_mismatch")


def _kind(key: str) -> Column:
    """JSON type of one top-level member, null when absent or JSON null."""
    raw = F.try_variant_get(F.col("doc"), f"$.{key}", "variant")
    kind = F.schema_of_variant(raw)
    return F.when(kind != "VOID", kind)


def _member(key: str, as_type: str) -> Column:
    return F.try_variant_get(F.col("doc"), f"$.{key}", as_type)


def parse_responses(responses: DataFrame) -> DataFrame:
    """responses(response_id, raw) with the parsed document and its top-level keys."""
    return responses.select(
        "response_id",
        F.try_parse_json("raw").alias("doc"),
        F.json_object_keys("raw").alias("keys"),
    )


def schema_flags(parsed: DataFrame, *carried: str) -> DataFrame:
    """AUD-01/05: row-local checks of keys, types, severity and provenance; `carried` columns stay."""
    keys = F.col("keys")
    allowed = F.array(*[F.lit(k) for k in ALLOWED_KEYS])
    required = F.array(*[F.lit(k) for k in REQUIRED_KEYS])
    not_object = keys.isNull()

    def has(key: str) -> Column:
        return F.array_contains(keys, key)

    def wrong(key: str, prefix: str) -> Column:
        kind = _kind(key)
        return kind.isNotNull() & ~kind.startswith(prefix)

    def not_text(key: str) -> Column:
        kind = _kind(key)
        return has(key) & (kind.isNull() | (kind != "STRING"))

    bad_version = has("schema_version") & ~(
        F.coalesce(_kind("schema_version") == "STRING", F.lit(False))
        & F.coalesce(_member("schema_version", "string") == SCHEMA_VERSION, F.lit(False))
    )
    invalid = (
        not_object
        | (F.size(F.array_except(required, keys)) > 0)
        | bad_version
        | not_text("narrative")
        | not_text("provenance")
        | wrong("referenced_evidence_ids", "ARRAY")
        | wrong("referenced_columns", "ARRAY")
        | wrong("numeric_claims", "OBJECT")
    )
    severity_kind = _kind("severity")
    return parsed.select(
        "response_id",
        *carried,
        F.coalesce(invalid, F.lit(True)).alias("schema_invalid"),
        F.coalesce(F.size(F.array_except(keys, allowed)) > 0, F.lit(False)).alias("unsupported_control_field"),
        F.coalesce(
            (_kind("provenance") == "STRING") & (_member("provenance", "string") != PROVENANCE), F.lit(False)
        ).alias("invalid_provenance"),
        F.coalesce(
            severity_kind.isNotNull()
            & ((severity_kind != "STRING") | ~_member("severity", "string").isin(*SEVERITIES)),
            F.lit(False),
        ).alias("invalid_severity"),
    )


# what an answer mentions, and what it was given
EVIDENCE, COLUMN, CLAIM, ANSWER = "evidence", "column", "claim", "answer"
_FLAGS = ("schema_invalid", "unsupported_control_field", "invalid_provenance", "invalid_severity")
_MENTION = "struct<kind: string, name: string, numeric: boolean, claimed: double>"


def _mentions() -> Column:
    """Everything an answer names, as one array: evidence, columns, numeric claims, and itself once."""
    nothing = F.lit(None)

    def listed(member: str, kind: str) -> Column:
        names = F.when(_kind(member).startswith("ARRAY"), _member(member, "array<string>"))
        one = F.transform(names, lambda x: F.struct(F.lit(kind), x, nothing.cast("boolean"), nothing.cast("double")).cast(_MENTION))
        return F.coalesce(one, F.array().cast(f"array<{_MENTION}>"))

    def claim(entry: Column) -> Column:
        kind = F.schema_of_variant(entry["value"])
        number = ~F.coalesce(kind.isin("STRING", "BOOLEAN", "VOID"), F.lit(True)) & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT")
        return F.struct(F.lit(CLAIM), entry["key"], number, F.try_variant_get(entry["value"], "$", "double")).cast(_MENTION)

    claims = F.when(_kind("numeric_claims").startswith("OBJECT"), F.map_entries(_member("numeric_claims", "map<string,variant>")))
    claimed = F.coalesce(F.transform(claims, claim), F.array().cast(f"array<{_MENTION}>"))
    itself = F.struct(F.lit(ANSWER), nothing.cast("string"), nothing.cast("boolean"), nothing.cast("double")).cast(_MENTION)
    return F.concat(F.array(itself), listed("referenced_evidence_ids", EVIDENCE), listed("referenced_columns", COLUMN), claimed)


def audit_flags(responses: DataFrame, evidence: DataFrame, columns: DataFrame, facts: DataFrame) -> DataFrame:
    """AUD-01..05: one row of flags per response id, and its number of numeric claims.

    Answers are parsed once and exploded into mentions with a kind; what each response was given
    joins them as further rows, and one aggregate per (response, kind, name) tells which mentions
    are known. A mention without a name is never known.
    """
    parsed = parse_responses(responses)
    flags = schema_flags(parsed.select("*", _mentions().alias("mentions")), "mentions")
    mentioned = flags.select(
        "response_id", F.inline("mentions"), F.struct(*_FLAGS).alias("flags"), F.lit(False).alias("given"), F.lit(None).cast("double").alias("fact")
    )
    no_flags = F.lit(None).cast(mentioned.schema["flags"].dataType)

    def held(rows: DataFrame, kind: str, name: str, value: Column) -> DataFrame:
        return rows.where(F.col(name).isNotNull()).select(
            "response_id", F.lit(kind).alias("kind"), F.col(name).alias("name"), F.lit(None).cast("boolean").alias("numeric"),
            F.lit(None).cast("double").alias("claimed"), no_flags.alias("flags"), F.lit(True).alias("given"), value.alias("fact"),
        )

    no_fact = F.lit(None).cast("double")
    every = mentioned.unionByName(held(evidence, EVIDENCE, "name", no_fact)).unionByName(held(columns, COLUMN, "name", no_fact))
    every = every.unionByName(held(facts.where("fact_value IS NOT NULL"), CLAIM, "fact", F.col("fact_value").cast("double")))
    by_name = every.groupBy("response_id", "kind", "name").agg(
        F.count_if(~F.col("given")).alias("named"), F.bool_or("given").alias("known"), F.max("flags").alias("flags"),
        F.bool_or("numeric").alias("numeric"), F.max("claimed").alias("claimed"), F.min("fact").alias("low"), F.max("fact").alias("high"),
    )
    named, known, numeric = F.col("named") > 0, F.col("known"), F.coalesce(F.col("numeric"), F.lit(False))
    claim = named & (F.col("kind") == CLAIM)
    off = (F.col("claimed") != F.col("low")) | (F.col("claimed") != F.col("high"))
    return (
        by_name.groupBy("response_id")
        .agg(
            F.max("flags").alias("flags"),
            F.bool_or(named & ~known & (F.col("kind") == EVIDENCE)).alias("unknown_evidence_id"),
            F.bool_or(named & ~known & (F.col("kind") == COLUMN)).alias("unknown_column"),
            F.bool_or(claim & ~known).alias("unknown_numeric_claim"),
            F.bool_or(F.coalesce(claim & known & numeric & off, F.lit(False))).alias("numeric_claim_mismatch"),
            F.bool_or(claim & known & ~numeric).alias("claim_not_numeric"),
            F.sum(F.when(claim, F.col("named")).otherwise(0)).alias("n_claims"),
        )
        .where(F.col("flags").isNotNull())  # what was given without an answer is no answer
        .select("response_id", "flags.*", *REASONS_OF_NAMES, "claim_not_numeric", "n_claims")
    )


def audit(
    responses: DataFrame, evidence: DataFrame, columns: DataFrame, facts: DataFrame
) -> DataFrame:
    """AUD-06: distinct reasons per response; accepted exactly when there are none.

    `evidence(response_id, name)`, `columns(response_id, name)` and `facts(response_id, fact,
    fact_value)` hold what each response was given.
    """
    flags = audit_flags(responses, evidence, columns, facts)
    flags = flags.withColumn("schema_invalid", F.col("schema_invalid") | F.col("claim_not_numeric"))
    reasons = F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in REASONS]))
    return flags.select("response_id", reasons.alias("reasons")).select(
        "response_id",
        (F.size("reasons") == 0).alias("accepted"),
        F.array_join("reasons", ", ").alias("reasons"),
    )


def run_report(tasks: DataFrame) -> DataFrame:
    """AUD-07: rates and means per model over tasks(model, accepted, consistent, duration_ms, retries)."""

    def rate(c: str) -> Column:
        return F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))

    return tasks.groupBy("model").agg(
        F.count("task_id").alias("task_count"),
        F.count_if("accepted").alias("accepted_count"),
        rate("accepted").alias("validity_rate"),
        rate("duration_ms").alias("average_duration_ms"),
        rate("retries").alias("average_retries"),
        rate("consistent").alias("consistency_rate"),
    )


