"""CTX-01..11 over the profile of the orders table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rowlens.operators import context as ctx
from rowlens.operators.profile import compute_profile
from rowlens.operators.table import Table
from workloads.base import *  # noqa: F403

# Order keys as text are a key; the other columns give dates, measures and dimensions.
EXPRS = (
    "o_orderkey AS row_number", "concat('ORD-', o_orderkey) AS order_id", "o_orderstatus AS status",
    "o_totalprice AS total_price", "CAST(o_orderdate AS DATE) AS order_date", "o_orderpriority AS priority",
    "o_custkey AS customer_number",
)
# The same facts from SQL: column, position, type.
PROFILE = (
    "WITH c AS (SELECT * FROM (SELECT unnest(['order_id','status','total_price','order_date','priority','customer_number']) AS name, "
    "unnest([0,1,2,3,4,5]) AS ordinal, unnest([d0, d1, d2, d3, d4, d5]) AS d, n FROM (SELECT count(DISTINCT o_orderkey) AS d0, "
    "count(DISTINCT o_orderstatus) AS d1, count(DISTINCT o_totalprice) AS d2, count(DISTINCT o_orderdate) AS d3, "
    "count(DISTINCT o_orderpriority) AS d4, count(DISTINCT o_custkey) AS d5, count(*) AS n FROM orders))), "
    "p AS (SELECT name, ordinal, CASE WHEN name IN ('total_price', 'customer_number') THEN 'numeric' WHEN name = 'order_date' THEN 'date' "
    "WHEN d = n THEN 'identifier' WHEN d / n <= 0.5 THEN 'categorical' ELSE 'text' END AS kind FROM c), "
    "h AS (SELECT 'business_dates' AS context_field, name AS proposed_value, 0.9 AS confidence, ordinal FROM p WHERE kind = 'date' UNION ALL "
    "SELECT 'measure_roles', name, 0.75, ordinal FROM p WHERE kind = 'numeric' UNION ALL SELECT 'dimensions', name, 0.7, ordinal FROM p WHERE kind = 'categorical'), "
    "k AS (SELECT 'candidate_keys' AS context_field, name AS proposed_value, 0.9 AS confidence FROM p WHERE kind = 'identifier') "
)


def profile(spark, sf):
    table = Table.from_dataframe(load(spark, sf, "orders").selectExpr(*EXPRS))
    return compute_profile(table, dt.date(2026, 1, 1)).column_profile


def _named(h):
    return h.select("context_field", "proposed_value", F.col("confidence").cast("double").alias("confidence"))


@register(
    "ctx_01",
    PROFILE + "SELECT context_field, proposed_value, CAST(confidence AS DOUBLE) AS confidence, concat('ctx-', context_field, '-', "
    "CAST(row_number() OVER (PARTITION BY context_field ORDER BY ordinal) AS VARCHAR)) AS hypothesis_id FROM h",
)
def ctx_01(spark, sf):
    return ctx.type_hypotheses(profile(spark, sf)).select(
        "context_field", "proposed_value", "confidence", "hypothesis_id"
    )


@register("ctx_02", PROFILE + "SELECT context_field, proposed_value, CAST(confidence AS DOUBLE) AS confidence FROM k")
def ctx_02(spark, sf):
    return _named(ctx.candidate_keys(profile(spark, sf)))


@register(
    "ctx_03",
    PROFILE + "SELECT 'row_grain' AS context_field, concat('One row per ', min(proposed_value)) AS proposed_value, CAST(0.6 AS DOUBLE) AS confidence FROM k HAVING count(*) = 1",
)
def ctx_03(spark, sf):
    return _named(ctx.row_grain(ctx.candidate_keys(profile(spark, sf))))


@register(
    "ctx_04",
    PROFILE + "SELECT 'primary_entity' AS context_field, regexp_extract(lower(min(proposed_value)), '^(.+)_id$', 1) AS proposed_value, "
    "CAST(0.55 AS DOUBLE) AS confidence FROM k HAVING count(*) = 1",
)
def ctx_04(spark, sf):
    return _named(ctx.primary_entity(ctx.candidate_keys(profile(spark, sf))))


@register(
    "ctx_05",
    PROFILE + "SELECT 'probable_domain' AS context_field, 'Sales / order transactions' AS proposed_value, CAST(0.5 AS DOUBLE) AS confidence FROM p "
    "WHERE regexp_matches(name, 'order|customer|product|sku|invoice|sale|price|quantity|discount|tax|region') HAVING count(*) >= 3",
)
def ctx_05(spark, sf):
    return _named(ctx.probable_domain(profile(spark, sf)))


@register(
    "ctx_06",
    PROFILE + "SELECT context_field, string_agg(proposed_value, ', ' ORDER BY proposed_value) AS value, CAST(avg(confidence) AS DOUBLE) AS confidence "
    "FROM (SELECT context_field, proposed_value, confidence FROM h UNION ALL SELECT * FROM k) GROUP BY 1",
)
def ctx_06(spark, sf):
    c = ctx.consolidate(ctx.hypotheses(profile(spark, sf)))
    return c.where(F.col("context_field").isin(*ctx.ROLE_FIELDS)).select("context_field", "value", F.round("confidence", 6).alias("confidence"))


_SINGLE = (
    "SELECT * FROM (VALUES ('probable_domain', 'Sales / order transactions', CAST(0.5 AS DOUBLE), 'inferred'), "
    "('row_grain', 'One row per order_id', 0.6, 'inferred'), ('primary_entity', 'order', 0.55, 'inferred'), "
    "('currency_behavior', 'unknown', 0.0, 'unknown'), ('expected_business_rules', 'unknown', 0.0, 'unknown')) "
    "t(context_field, value, confidence, confirmation_state) WHERE EXISTS (SELECT 1 FROM orders)"
)


def _context(spark, sf):
    return ctx.consolidate(ctx.hypotheses(profile(spark, sf)))


@register("ctx_07", _SINGLE)
def ctx_07(spark, sf):
    return _context(spark, sf).where(~F.col("context_field").isin(*ctx.ROLE_FIELDS)).select(
        "context_field", "value", "confidence", "confirmation_state"
    )


@register(
    "ctx_08",
    "SELECT * FROM (VALUES ('cq-currency_behavior-1', 'currency_behavior'), ('cq-expected_business_rules-1', 'expected_business_rules')) "
    "t(question_id, context_field) WHERE EXISTS (SELECT 1 FROM orders)",
)
def ctx_08(spark, sf):
    return ctx.guided_questions(_context(spark, sf)).select("question_id", "context_field")


def _changed(frame):
    return frame.where(F.col("inference_source").startswith("user_")).select(
        "context_field", "value", "confidence", "inference_source", "confirmation_state"
    )


@register(
    "ctx_09",
    "SELECT * FROM (VALUES ('row_grain', 'One row per order_id', CAST(1.0 AS DOUBLE), 'user_confirmed', 'confirmed'), "
    "('primary_entity', 'purchase', 1.0, 'user_corrected', 'corrected')) "
    "t(context_field, value, confidence, inference_source, confirmation_state) WHERE EXISTS (SELECT 1 FROM orders)",
)
def ctx_09(spark, sf):
    edits = {"row_grain": "One row per order_id", "primary_entity": "purchase"}
    edited, _ = ctx.confirm_fields(_context(spark, sf), edits, version=1, expected_version=1)
    return _changed(edited)


@register(
    "ctx_10",
    "SELECT * FROM (VALUES ('currency_behavior', 'Multiple currencies', CAST(1.0 AS DOUBLE), 'user_confirmed', 'confirmed'), "
    "('expected_business_rules', 'totals add up', 1.0, 'user_corrected', 'corrected')) "
    "t(context_field, value, confidence, inference_source, confirmation_state) WHERE EXISTS (SELECT 1 FROM orders)",
)
def ctx_10(spark, sf):
    answers = spark.createDataFrame(
        [("cq-currency_behavior-1", "Multiple currencies"), ("cq-expected_business_rules-1", "totals add up")],
        "question_id string, answer string",
    )
    return _changed(ctx.answer_questions(_context(spark, sf), answers))


@register(
    "ctx_11",
    "SELECT 'currency_behavior' AS context_field, 'Single currency throughout' AS value, CAST(0.4 AS DOUBLE) AS confidence, "
    "'ai_interpretation' AS inference_source WHERE EXISTS (SELECT 1 FROM orders)",
)
def ctx_11(spark, sf):
    extra = spark.createDataFrame(
        [("ctx-ai-1", "currency_behavior", "Single currency throughout", 0.4, "ai_interpretation", 1)],
        "hypothesis_id string, context_field string, proposed_value string, confidence double, provenance string, position int",
    )
    c = ctx.consolidate(ctx.hypotheses(profile(spark, sf), extra))
    return c.where(F.col("context_field") == "currency_behavior").select(
        "context_field", "value", "confidence", "inference_source"
    )
