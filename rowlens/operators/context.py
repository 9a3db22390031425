"""Dataset context (CTX-01..11): hypotheses from the column profile, consolidated per field.

Everything here works on the profile, which has one row per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fields, confidences and markers.
FIELDS = (
    "probable_domain", "row_grain", "primary_entity", "candidate_keys", "business_dates",
    "measure_roles", "dimensions", "currency_behavior", "expected_business_rules",
)
ROLE_FIELDS = ("candidate_keys", "business_dates", "measure_roles", "dimensions")
EDITABLE_FIELDS = tuple(f for f in FIELDS if f not in ROLE_FIELDS)
TYPE_ROLES = (
    ("date", "business_dates", 0.9),
    ("numeric", "measure_roles", 0.75),
    ("categorical", "dimensions", 0.7),
)
UNIQUE_KEY_CONFIDENCE = 0.9
LIKELY_KEY_CONFIDENCE = 0.7
GRAIN_CONFIDENCE = 0.6
ENTITY_CONFIDENCE = 0.55
DOMAIN_CONFIDENCE = 0.5
SALES_MARKERS = (
    "order", "customer", "product", "sku", "invoice", "sale", "price",
    "quantity", "discount", "tax", "region",
)
SALES_MIN_MATCHES = 3
SALES_DOMAIN = "Sales / order transactions"

# Questions asked about fields nothing could be inferred for, in asking order.
QUESTIONS = (
    ("probable_domain", "What kind of dataset is this?",
     ("Sales / order transactions", "Inventory / stock records", "Customer / CRM records",
      "Financial / accounting records", "Other")),
    ("row_grain", "What does one row in this dataset represent?", ()),
    ("primary_entity", "What is the main business entity this dataset tracks?", ()),
    ("currency_behavior",
     "What currency are monetary values expressed in, and is it consistent throughout?",
     ("Single currency throughout", "Multiple currencies", "Not applicable — no monetary values")),
    ("expected_business_rules",
     "Are there specific business rules this dataset should satisfy?", ()),
)


def _numbered(frame: DataFrame, field: str, confidence) -> DataFrame:
    rank = F.row_number().over(W.orderBy("ordinal"))
    return frame.select(
        F.concat(F.lit(f"ctx-{field}-"), rank.cast("string")).alias("hypothesis_id"),
        F.lit(field).alias("context_field"),
        F.col("original_name").alias("proposed_value"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
        F.lit("calculated").alias("provenance"),
        rank.alias("position"),
    )


def type_hypotheses(profile: DataFrame) -> DataFrame:
    """CTX-01."""
    return reduce(
        DataFrame.unionByName,
        [
            _numbered(profile.where(F.col("inferred_type") == kind), field, confidence)
            for kind, field, confidence in TYPE_ROLES
        ],
    )


def candidate_keys(profile: DataFrame) -> DataFrame:
    """CTX-02."""
    unique = F.col("inferred_type") == "identifier"
    likely = (F.col("inferred_type") == "text") & F.coalesce("likely_identifier", F.lit(False))
    keys = profile.where(unique | likely)
    return _numbered(
        keys, "candidate_keys", F.when(unique, UNIQUE_KEY_CONFIDENCE).otherwise(LIKELY_KEY_CONFIDENCE)
    )


def _single(frame: DataFrame, field: str, value, confidence: float) -> DataFrame:
    return frame.select(
        F.lit(f"ctx-{field}-1").alias("hypothesis_id"),
        F.lit(field).alias("context_field"),
        value.alias("proposed_value"),
        F.lit(confidence).alias("confidence"),
        F.lit("calculated").alias("provenance"),
        F.lit(1).alias("position"),
    )


def _sole_key(keys: DataFrame) -> DataFrame:
    return keys.agg(
        F.count(F.lit(1)).alias("n"), F.first("proposed_value").alias("key")
    ).where(F.col("n") == 1)


def row_grain(keys: DataFrame) -> DataFrame:
    """CTX-03."""
    return _single(
        _sole_key(keys), "row_grain", F.concat(F.lit("One row per "), "key"), GRAIN_CONFIDENCE
    )


def primary_entity(keys: DataFrame) -> DataFrame:
    """CTX-04."""
    entity = F.regexp_extract(F.lower("key"), "(?s)^(.+)_id$", 1)
    return _single(
        _sole_key(keys).where(entity != ""), "primary_entity", entity, ENTITY_CONFIDENCE
    )


def probable_domain(profile: DataFrame) -> DataFrame:
    """CTX-05."""
    name = F.lower("original_name")
    marked = reduce(lambda a, b: a | b, [name.contains(m) for m in SALES_MARKERS])
    matched = profile.agg(F.count_if(marked).alias("n")).where(F.col("n") >= SALES_MIN_MATCHES)
    return _single(matched, "probable_domain", F.lit(SALES_DOMAIN), DOMAIN_CONFIDENCE)


def hypotheses(profile: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """All hypotheses; an accepted external one (CTX-11) is appended before consolidation."""
    keys = candidate_keys(profile)
    frames = [keys, type_hypotheses(profile), row_grain(keys), primary_entity(keys), probable_domain(profile)]
    if extra is not None:
        frames.append(extra)
    return reduce(DataFrame.unionByName, frames)


def consolidate(hyps: DataFrame) -> DataFrame:
    """CTX-06/07: one row per field. Role fields take all values, the others the most confident."""
    spark = hyps.sparkSession
    fields = spark.createDataFrame(
        [(i, f, f in ROLE_FIELDS) for i, f in enumerate(FIELDS)],
        "field_order int, context_field string, is_role boolean",
    )
    best = F.max_by(
        F.struct("proposed_value", "provenance"), F.struct("confidence", -F.col("position"), "hypothesis_id")
    )
    grouped = hyps.groupBy("context_field").agg(
        F.array_join(F.sort_array(F.collect_set("proposed_value")), ", ").alias("all_values"),
        F.avg("confidence").alias("mean_confidence"),
        best.alias("best"),
        F.max("confidence").alias("top_confidence"),
    )
    known = F.col("top_confidence").isNotNull()
    return fields.join(grouped, "context_field", "left").select(
        "field_order",
        "context_field",
        F.when(~known, F.when(F.col("is_role"), "").otherwise("unknown"))
        .when(F.col("is_role"), F.col("all_values"))
        .otherwise(F.col("best.proposed_value"))
        .alias("value"),
        F.when(~known, 0.0)
        .when(F.col("is_role"), F.col("mean_confidence"))
        .otherwise(F.col("top_confidence"))
        .alias("confidence"),
        F.when(~known, "deterministic_fallback")
        .when(F.col("is_role"), "calculated")
        .otherwise(F.col("best.provenance"))
        .alias("inference_source"),
        F.when(known, "inferred").otherwise("unknown").alias("confirmation_state"),
    )


def question_frame(spark) -> DataFrame:
    return spark.createDataFrame(
        [(i, f"cq-{f}-1", f, q, list(a)) for i, (f, q, a) in enumerate(QUESTIONS)],
        "asking_order int, question_id string, context_field string, question string, "
        "suggested_answers array<string>",
    )


def guided_questions(context: DataFrame) -> DataFrame:
    """CTX-08: one per single-value field still unknown, at most five."""
    unknown = context.where(F.col("confirmation_state") == "unknown").select("context_field")
    return question_frame(context.sparkSession).join(unknown, "context_field", "left_semi")


def _edited(context: DataFrame, edits: DataFrame, confirmed) -> DataFrame:
    joined = context.join(edits, "context_field", "left")
    touched = F.col("new_value").isNotNull()
    state = F.when(confirmed, "confirmed").otherwise("corrected")
    return joined.select(
        "field_order",
        "context_field",
        F.coalesce("new_value", "value").alias("value"),
        F.when(touched, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(touched, F.concat(F.lit("user_"), state)).otherwise(F.col("inference_source")).alias("inference_source"),
        F.when(touched, state).otherwise(F.col("confirmation_state")).alias("confirmation_state"),
    )


def confirm_fields(
    context: DataFrame, edits: dict[str, str], *, version: int, expected_version: int
) -> tuple[DataFrame, int]:
    """CTX-09: version-checked edits of the single-value fields."""
    if not edits:
        raise ValueError("there is nothing to confirm")
    if version != expected_version:
        raise ValueError(f"context is at version {version}, not {expected_version}")
    fixed = sorted(set(edits) - set(EDITABLE_FIELDS))
    if fixed:
        raise ValueError(f"not editable: {fixed}")
    frame = context.sparkSession.createDataFrame(list(edits.items()), "context_field string, new_value string")
    return _edited(context, frame, F.col("new_value") == F.col("value")), version + 1


def answer_questions(context: DataFrame, answers: DataFrame) -> DataFrame:
    """CTX-10: answers(question_id, answer); a suggested answer confirms, any other corrects."""
    asked = answers.join(question_frame(context.sparkSession), "question_id").select(
        "context_field",
        F.col("answer").alias("new_value"),
        F.array_contains("suggested_answers", F.col("answer")).alias("suggested"),
    )
    return _edited(context, asked, F.col("suggested"))
