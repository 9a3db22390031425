"""WIN-01..04, HIS-01..08, AUD-01..07."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowlens.operators import audit as aud
from rowlens.operators import history as his
from rowlens.operators import windows as win
from rowlens.operators.detectors import observations
from workloads.base import *  # noqa: F403
from workloads.detectors import detect

# --- WIN --------------------------------------------------------------------------------------

_OV = view_sql("orders_view", ["priority"])


def _window_sql(anchors: str, marked: str, before: int, after: int) -> str:
    return (
        f"WITH src AS ({_OV}), n AS (SELECT count(*) AS rows FROM src), a AS ({anchors}), mk AS ({marked}), "
        f"w AS (SELECT anchor_row, unnest(range(anchor_row - {before}, anchor_row + {after} + 1)) AS row_number FROM a) "
        "SELECT w.anchor_row, w.row_number, w.row_number = w.anchor_row AS is_anchor, w.row_number IN (SELECT row_number FROM mk) AS is_affected, "
        f"w.anchor_row - {before} < 0 AS truncated_at_start, w.anchor_row + {after} > n.rows - 1 AS truncated_at_end, s.priority "
        "FROM w JOIN src s USING (row_number), n"
    )


_GAPS = f"SELECT row_number FROM src WHERE {s_missing('priority')}"
_WIN_COLUMNS = ["anchor_row", "row_number", "is_anchor", "is_affected", "truncated_at_start", "truncated_at_end", "priority"]


@register("win_01", _window_sql(_GAPS.replace("row_number FROM", "row_number AS anchor_row FROM"), _GAPS, 3, 5))
def win_01(spark, sf):
    """Windows around every row of a finding at once."""
    from rowlens.operators.detectors import values

    table = view_table(spark, sf, "orders_view", ["priority"])
    rows = detect(table, values.MISSING_VALUES).finding_rows
    anchors = rows.select(F.col("row_number").alias("anchor_row"))
    return win.row_windows(table, anchors, rows, before=3, after=5).select(*_WIN_COLUMNS)


_OBS = (
    f"SELECT row_number FROM (SELECT row_number, {s_date_family('written_day')} AS f FROM ({view_sql('orders_view', ['written_day'])})) "
    "WHERE f <> 'iso_year_month_day' ORDER BY row_number LIMIT 20"
)


@register("win_02", _window_sql(_OBS.replace("SELECT row_number FROM", "SELECT row_number AS anchor_row FROM", 1), _OBS, 2, 2))
def win_02(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["written_day"]), observations.DATE_FORMATS)
    key = "consistency.inconsistent_date_formats.written_day"
    table = view_table(spark, sf, "orders_view", ["priority"])
    anchors = win.observation_anchors(d.observation_rows, key)
    return win.row_windows(table, anchors, d.observation_rows, before=2, after=2).select(*_WIN_COLUMNS)


_F3 = "SELECT o_custkey AS c, min(o_orderkey) AS first_order FROM {orders} GROUP BY o_custkey"


@register(
    "win_03",
    f"WITH f AS ({_F3.format(orders='orders')}), fi AS (SELECT concat('f', CAST(c AS VARCHAR)) AS finding_key, c % 2 AS affected, c % 5 AS ordinal FROM f), "
    "obs AS (SELECT ordinal, row_number FROM (SELECT o_orderkey % 3 AS ordinal, o_orderkey AS row_number, "
    "row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 20) "
    "SELECT finding_key, CAST(coalesce(row_number, 0) AS BIGINT) AS anchor_row, CASE WHEN row_number IS NULL THEN 'start_of_file' "
    "ELSE 'observation_example' END AS anchor_source FROM fi LEFT JOIN obs USING (ordinal) WHERE affected = 0",
)
def win_03(spark, sf):
    """One finding per customer; observations name the last rows of three columns."""
    from pyspark.sql import Window as W

    orders = load(spark, sf, "orders")
    base = orders.select(F.col("o_custkey").alias("c")).distinct()
    findings = base.selectExpr("concat('f', c) AS finding_key", "c % 2 AS affected_row_count")
    columns = base.selectExpr("concat('f', c) AS finding_key", "CAST(c % 5 AS INT) AS ordinal")
    rank = F.row_number().over(W.partitionBy("ordinal").orderBy(F.desc("row_number")))
    shown = orders.selectExpr("CAST(o_orderkey % 3 AS INT) AS ordinal", "o_orderkey AS row_number")
    return win.column_wide_anchors(findings, columns, shown.withColumn("r", rank).where("r <= 20"))


@register("win_04")
def win_04(spark, sf):
    """Windows over long documents under a character budget; checked against brute force in tests."""
    docs = load(spark, sf, "documents").selectExpr("doc_id", "length(text) + 1 AS _cost")
    asked = docs.select(F.col("doc_id").alias("anchor_row"), F.explode(F.sequence(F.col("doc_id") - 5, F.col("doc_id") + 5)).alias("row_number"))
    costs = asked.join(docs.withColumnRenamed("doc_id", "row_number"), "row_number")
    return win.fit_windows(costs, 20_000)


# --- HIS --------------------------------------------------------------------------------------

RUNS = (
    "SELECT concat('a', CAST(event_id AS STRING)) AS analysis_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' "
    "ELSE 'completed' END AS state, concat(CASE WHEN event_id % 2 = 0 THEN 'File' ELSE 'file' END, CAST(user_id AS STRING), '.csv') AS original_filename, "
    "'csv' AS dataset_format, CAST(floor(value * 100) AS BIGINT) AS byte_size, ts AS created_at, "
    "CASE WHEN event_type = 'click' THEN 'high_confidence' ELSE 'usable_with_caution' END AS trust_label, event_id % 30 AS finding_count, "
    "md5(concat('content', CAST(user_id % 40 AS STRING))) AS content_sha256 FROM events"
)


def _ev(spark, sf, text):
    load(spark, sf, "events").createOrReplaceTempView("rowlens_events")
    return spark.sql(text.replace("FROM events", "FROM rowlens_events"))


_SUMMARY = "analysis_id, state, original_filename, dataset_format, byte_size, trust_label, finding_count"


def _summary(frame):
    return frame.drop("created_at")


@register("his_01", f"WITH r AS ({RUNS}) SELECT {_SUMMARY} FROM r ORDER BY created_at DESC, analysis_id LIMIT 20")
def his_01(spark, sf):
    return _summary(his.recent(_ev(spark, sf, RUNS)))


@register(
    "his_02",
    f"WITH r AS ({RUNS}) SELECT {_SUMMARY} FROM r WHERE content_sha256 = md5('content7') AND state = 'completed' "
    "ORDER BY created_at DESC, analysis_id LIMIT 50",
)
def his_02(spark, sf):
    return _summary(his.completed_with_content(_ev(spark, sf, RUNS), F.md5(F.lit("content7"))))


@register(
    "his_03",
    f"WITH r AS ({RUNS}), x AS (SELECT * FROM r WHERE content_sha256 = md5('content7') AND state = 'completed' ORDER BY created_at DESC, analysis_id LIMIT 50), "
    "t AS (SELECT * FROM r ORDER BY created_at DESC, analysis_id LIMIT 50), last AS (SELECT original_filename FROM t WHERE state = 'completed' ORDER BY created_at DESC LIMIT 1), "
    "y AS (SELECT * FROM t WHERE state = 'completed' AND lower(original_filename) = (SELECT lower(original_filename) FROM last)) "
    "SELECT 'bytes' AS asked, 'same_file' AS kind, count(*) AS matches, arg_max(analysis_id, created_at) AS latest FROM x UNION ALL "
    "SELECT 'name', 'same_name', count(*), arg_max(analysis_id, created_at) FROM y",
)
def his_03(spark, sf):
    runs = _ev(spark, sf, RUNS)
    known = runs.select(F.md5(F.lit("content7"))).first()[0]
    last = his.recent(runs, 50).where("state = 'completed'").orderBy(F.desc("created_at")).first()
    exact = his.seen_before(runs, known, "other.csv").withColumn("asked", F.lit("bytes"))
    named = his.seen_before(runs, "no such hash", last["original_filename"].upper()).withColumn("asked", F.lit("name"))
    return exact.unionByName(named)


@register("his_04", f"WITH r AS ({RUNS}) SELECT {_SUMMARY} FROM r")
def his_04(spark, sf):
    return _summary(his.summaries(_ev(spark, sf, RUNS)))


VERSIONS = (
    "SELECT concat('a', CAST(user_id % 10 AS STRING)) AS analysis_id, concat('r', CAST(user_id AS STRING)) AS relationship_id, "
    "CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS version, 'start_end_date' AS kind, "
    "CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'confirm' WHEN event_type = 'error' THEN 'withdraw' "
    "ELSE 'replace' END AS transition, concat('s', CAST(event_id AS STRING)) AS start_key, concat('e', CAST(event_id AS STRING)) AS end_key FROM events"
)
_CURRENT = (
    f"WITH v AS ({VERSIONS}), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relationship_id ORDER BY version DESC) AS r, "
    "count(*) OVER (PARTITION BY relationship_id) AS versions FROM v) WHERE r = 1) "
)


@register(
    "his_05",
    _CURRENT + "SELECT analysis_id, relationship_id, CAST(version AS BIGINT) AS version, transition, start_key, versions, "
    "CASE WHEN transition = 'withdraw' THEN 'withdrawn' ELSE 'active' END AS state FROM c",
)
def his_05(spark, sf):
    return his.relationship_views(_ev(spark, sf, VERSIONS)).select(
        "analysis_id", "relationship_id", big("version"), "transition", "start_key", "versions", "state"
    )


@register("his_06", _CURRENT + "SELECT analysis_id, count(*) FILTER (transition <> 'withdraw') AS active_count FROM c GROUP BY 1")
def his_06(spark, sf):
    return his.active_relationships(_ev(spark, sf, VERSIONS))


# ten users share an analysis; every signup mints an id, and a user's later requests name the newest one
REQUESTS = (
    "WITH named AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS minted FROM events) "
    "SELECT concat('a', CAST(floor(user_id / 10) AS STRING)) AS analysis_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'confirm' "
    "WHEN 'error' THEN 'withdraw' ELSE 'replace' END AS transition, 'start_end_date' AS kind, "
    "CASE WHEN event_type = 'signup' THEN NULL ELSE concat('r', CAST(coalesce(minted, -user_id) AS STRING)) END AS relationship_id, "
    "CASE WHEN event_type = 'signup' THEN NULL WHEN event_id % 13 = 0 THEN NULL ELSE CAST(1 + event_id % 3 AS INT) END AS expected_version, "
    "CASE WHEN event_type = 'error' THEN NULL ELSE concat('s', CAST(event_id AS STRING)) END AS start_key, "
    "CASE WHEN event_type = 'error' THEN NULL ELSE concat('e', CAST(event_id AS STRING)) END AS end_key, "
    "concat('r', CAST(event_id AS STRING)) AS new_id FROM named"
)


@register("his_07")
def his_07(spark, sf):
    """Ordered replay of a request log; checked against brute force in tests."""
    return his.decide_transitions(_ev(spark, sf, REQUESTS))


CALLS = (
    "SELECT concat('a', CAST(user_id AS STRING)) AS analysis_id, CASE event_type WHEN 'error' THEN 'provider_error' WHEN 'view' THEN 'rejected' "
    "ELSE 'accepted' END AS outcome, event_id % 97 = 0 AS evidence_sent, event_id % 193 = 0 AS context_sent, "
    "CASE WHEN user_id % 3 = 0 AND event_id % 50 = 0 THEN 'remote' ELSE 'local' END AS location FROM events"
)


@register(
    "his_08",
    f"WITH c AS ({CALLS}) SELECT analysis_id, count(*) FILTER (outcome = 'accepted') AS accepted_count, count(*) FILTER (outcome = 'rejected') AS rejected_count, "
    "count(*) FILTER (outcome = 'provider_error') AS provider_error_count, bool_or(evidence_sent) AS evidence_sent, bool_or(context_sent) AS context_sent, "
    "CASE WHEN count(DISTINCT location) > 1 THEN 'unknown' ELSE min(location) END AS model_location FROM c GROUP BY 1",
)
def his_08(spark, sf):
    return his.call_counters(_ev(spark, sf, CALLS))


# --- AUD --------------------------------------------------------------------------------------

# Every conversation turn is one model answer about evidence e<conv> and column c<conv % 7>.
RAW = (
    "CASE WHEN (conv_id + turn) % 23 = 0 THEN 'not json' ELSE concat('{\"schema_version\":', "
    "CASE WHEN (conv_id + turn) % 11 = 0 THEN '1' ELSE '\"1\"' END, ',\"narrative\":\"', role, '\",\"provenance\":\"', "
    "CASE WHEN (conv_id + turn) % 7 = 0 THEN 'calculated' ELSE 'ai_interpretation' END, '\"', "
    "CASE WHEN (conv_id + turn) % 5 = 0 THEN ',\"delete_rows\":true' ELSE '' END, "
    "CASE WHEN turn % 3 = 0 THEN concat(',\"referenced_evidence_ids\":[\"e', CAST(conv_id + turn % 2 AS STRING), '\"]') ELSE '' END, "
    "CASE WHEN turn % 2 = 0 THEN concat(',\"referenced_columns\":[\"c', CAST((conv_id + turn) % 7 AS STRING), '\"]') ELSE '' END, "
    "',\"numeric_claims\":{\"rows\":', CAST(conv_id + turn % 3 AS STRING), CASE WHEN turn % 4 = 3 THEN ',\"extra\":1' ELSE '' END, '}', "
    "CASE WHEN (conv_id + turn) % 13 = 0 THEN ',\"severity\":\"urgent\"' WHEN turn = 1 THEN ',\"severity\":\"high\"' ELSE '' END, '}') END"
)
RESPONSES = f"SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS response_id, conv_id, {RAW} AS raw FROM conversations"


def _conv(spark, sf, text):
    load(spark, sf, "conversations").createOrReplaceTempView("rowlens_conversations")
    return spark.sql(text.replace("FROM conversations", "FROM rowlens_conversations"))


def _audit_inputs(spark, sf):
    responses = _conv(spark, sf, RESPONSES)
    evidence = responses.selectExpr("response_id", "concat('e', conv_id) AS name")
    columns = responses.selectExpr("response_id", "concat('c', conv_id % 7) AS name")
    facts = responses.selectExpr("response_id", "'rows' AS fact", "CAST(conv_id AS DOUBLE) AS fact_value")
    return responses, evidence, columns, facts


_OK = "json_valid(raw)"
_J = f"WITH r AS ({RESPONSES}), j AS (SELECT response_id, conv_id, raw, CASE WHEN {_OK} THEN CAST(raw AS JSON) END AS d FROM r), "
_FLAGS = _J + (
    "f AS (SELECT response_id, d IS NULL OR json_type(d, '$.schema_version') <> 'VARCHAR' OR json_extract_string(d, '$.schema_version') <> '1' AS schema_invalid, "
    "coalesce(json_exists(d, '$.delete_rows'), FALSE) AS unsupported_control_field, coalesce(json_extract_string(d, '$.provenance') <> 'ai_interpretation', FALSE) AS invalid_provenance, "
    "coalesce(json_extract_string(d, '$.severity') NOT IN ('critical', 'high', 'medium', 'low', 'informational'), FALSE) AS invalid_severity, "
    "coalesce(json_extract_string(d, '$.referenced_evidence_ids[0]') <> concat('e', CAST(conv_id AS VARCHAR)), FALSE) AS unknown_evidence_id, "
    "coalesce(json_extract_string(d, '$.referenced_columns[0]') <> concat('c', CAST(conv_id % 7 AS VARCHAR)), FALSE) AS unknown_column, "
    "coalesce(json_exists(d, '$.numeric_claims.extra'), FALSE) AS unknown_numeric_claim, "
    "coalesce(CAST(json_extract_string(d, '$.numeric_claims.rows') AS BIGINT) <> conv_id, FALSE) AS numeric_claim_mismatch FROM j) "
)


@register("aud_01", _FLAGS + "SELECT response_id, schema_invalid, unsupported_control_field FROM f")
def aud_01(spark, sf):
    parsed = aud.parse_responses(_conv(spark, sf, RESPONSES))
    return aud.schema_flags(parsed).select("response_id", "schema_invalid", "unsupported_control_field")


@register("aud_02", _FLAGS + "SELECT response_id FROM f WHERE unknown_evidence_id")
def aud_02(spark, sf):
    return aud.audit_flags(*_audit_inputs(spark, sf)).where("unknown_evidence_id").select("response_id")


@register("aud_03", _FLAGS + "SELECT response_id FROM f WHERE unknown_column")
def aud_03(spark, sf):
    return aud.audit_flags(*_audit_inputs(spark, sf)).where("unknown_column").select("response_id")


@register("aud_04", _FLAGS + "SELECT f.response_id, unknown_numeric_claim, numeric_claim_mismatch FROM f JOIN j USING (response_id) WHERE d IS NOT NULL")
def aud_04(spark, sf):
    flags = aud.audit_flags(*_audit_inputs(spark, sf)).where("n_claims > 0")
    return flags.select("response_id", "unknown_numeric_claim", "numeric_claim_mismatch")


@register("aud_05", _FLAGS + "SELECT response_id, invalid_provenance, invalid_severity FROM f")
def aud_05(spark, sf):
    parsed = aud.parse_responses(_conv(spark, sf, RESPONSES))
    return aud.schema_flags(parsed).select("response_id", "invalid_provenance", "invalid_severity")


_REASONS = "concat_ws(', ', " + ", ".join(f"CASE WHEN {r} THEN '{r}' END" for r in aud.REASONS) + ")"


@register("aud_06", _FLAGS + f"SELECT response_id, {_REASONS} = '' AS accepted, {_REASONS} AS reasons FROM f")
def aud_06(spark, sf):
    return aud.audit(*_audit_inputs(spark, sf))


TASKS = (
    "SELECT concat('m', CAST(user_id % 6 AS STRING)) AS model, event_id AS task_id, event_type <> 'error' AS accepted, event_id % 3 = 0 AS consistent, "
    "value * 100 AS duration_ms, event_id % 2 AS retries FROM events"
)


@register(
    "aud_07",
    f"WITH t AS ({TASKS}) SELECT model, count(*) AS task_count, count(*) FILTER (accepted) AS accepted_count, "
    "round(avg(CAST(accepted AS INT)), 6) AS validity_rate, round(avg(duration_ms), 4) AS average_duration_ms, "
    "round(avg(retries), 6) AS average_retries, round(avg(CAST(consistent AS INT)), 6) AS consistency_rate FROM t GROUP BY 1",
)
def aud_07(spark, sf):
    r = aud.run_report(_ev(spark, sf, TASKS))
    return r.select(
        "model", "task_count", "accepted_count", F.round("validity_rate", 6).alias("validity_rate"),
        F.round("average_duration_ms", 4).alias("average_duration_ms"),
        F.round("average_retries", 6).alias("average_retries"), F.round("consistency_rate", 6).alias("consistency_rate"),
    )
