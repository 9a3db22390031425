"""FND-01..20, over findings derived from the given tables.

Findings of a run are rows; here every order is a finding of some detector on a few of the
columns of a table with five columns, which gives lists of any size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rowlens.operators import findings as fnd
from rowlens.operators.guidance import GENERIC, TEMPLATES
from workloads.base import *  # noqa: F403

K = "o_orderkey"
DETECTORS = list(TEMPLATES)[:10] + ["custom.detector"]
COLS = ("order_id", "unit_price", "note", "region", "day")
TYPES = ("identifier", "numeric", "text", "categorical", "date")

FINDINGS = (
    f"SELECT {K} AS finding_index, concat('f', CAST({K} AS STRING)) AS finding_key, "
    f"CASE {K} % 11 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DETECTORS)) + " END AS detector_id, "
    f"CASE {K} % 5 WHEN 0 THEN 'structural' WHEN 1 THEN 'ai_processing_security' WHEN 2 THEN 'validity' ELSE 'consistency' END AS category, "
    f"CASE {K} % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'informational' ELSE 'low' END AS severity, "
    f"CAST(CASE WHEN {K} % 2 = 0 THEN 1.0 ELSE 0.75 END AS DOUBLE) AS confidence, "
    "concat('Order of ', o_orderpriority) AS observation, CAST(o_custkey % 40 AS BIGINT) AS affected_row_count FROM orders"
)
# A finding names between no and two columns.
COLUMNS = (
    f"SELECT concat('f', CAST({K} AS STRING)) AS finding_key, 0 AS position, CAST({K} % 5 AS INT) AS ordinal FROM orders WHERE {K} % 6 <> 0 "
    f"UNION ALL SELECT concat('f', CAST({K} AS STRING)), 1, CAST(({K} + 1) % 5 AS INT) FROM orders WHERE {K} % 6 > 3"
)
NAMES = "CASE ordinal " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(COLS)) + " END"
KINDS = "CASE ordinal " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"
NAMED = f"SELECT finding_key, position, ordinal, {NAMES} AS internal_key, {NAMES} AS original_name FROM cols"
REVIEWS = (
    f"SELECT concat('f', CAST({K} AS STRING)) AS finding_key, CASE o_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' "
    "WHEN 2 THEN 'needs_investigation' ELSE 'unreviewed' END AS review_state, CAST(NULL AS STRING) AS note, "
    f"CASE WHEN {K} % 3 = 0 THEN 'known' ELSE '' END AS dismissal_reason, o_custkey AS reviewed_at FROM orders WHERE {K} % 2 = 0 "
    f"UNION ALL SELECT concat('f', CAST({K} AS STRING)), 'confirmed', 'later', '', o_custkey + 1 FROM orders WHERE {K} % 10 = 0"
)
ROWS = "SELECT concat('f', CAST(o_custkey AS STRING)) AS finding_key, o_orderkey AS row_number FROM orders"
POPULATION = 40

PRE = (
    f"WITH f AS ({FINDINGS}), cols AS ({COLUMNS}), fc AS ({NAMED}), "
    f"roles AS (SELECT finding_key, bool_or({KINDS} IN ('identifier', 'date')) AS keyed, "
    "bool_or(regexp_matches(lower(original_name), 'price|total|amount|cost|revenue|balance|payment|fee|charge|value')) AS monetary "
    "FROM fc GROUP BY finding_key), scored AS (SELECT f.*, greatest(least(CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 75 "
    "WHEN 'medium' THEN 50 WHEN 'low' THEN 25 ELSE 10 END * confidence + least(affected_row_count / 40 * 15, 15) "
    "+ least((CASE WHEN keyed THEN 10 ELSE 0 END) + (CASE WHEN monetary THEN 10 ELSE 0 END), 15), 100), 0) AS priority_score "
    "FROM f LEFT JOIN roles USING (finding_key)), "
    "pairs AS (SELECT DISTINCT finding_key, internal_key FROM fc), "
    "counts AS (SELECT internal_key, count(*) AS n FROM pairs GROUP BY 1), "
    "re AS (SELECT finding_key, bool_or(n >= 2) AS is_reinforced FROM pairs JOIN counts USING (internal_key) GROUP BY 1), "
    f"rv AS ({REVIEWS}), ok AS (SELECT * FROM rv WHERE review_state <> 'dismissed' OR length(trim(coalesce(dismissal_reason, ''))) > 0), "
    "latest AS (SELECT finding_key, review_state FROM (SELECT *, row_number() OVER (PARTITION BY finding_key "
    "ORDER BY reviewed_at DESC, review_state DESC) AS r FROM ok) WHERE r = 1), "
    "reviewed AS (SELECT s.*, coalesce(l.review_state, 'unreviewed') AS review_state FROM scored s LEFT JOIN latest l USING (finding_key)) "
)


def _sql(spark, sf, text):
    load(spark, sf, "orders").createOrReplaceTempView("rowlens_orders")
    return spark.sql(text.replace("FROM orders", "FROM rowlens_orders"))


def findings(spark, sf):
    return _sql(spark, sf, FINDINGS)


def columns(spark, sf):
    cols = _sql(spark, sf, COLUMNS)
    name = F.element_at(F.array(*[F.lit(c) for c in COLS]), F.col("ordinal") + 1)
    return cols.select("finding_key", "position", "ordinal", name.alias("internal_key"), name.alias("original_name"))


def column_profile(spark):
    return spark.createDataFrame(
        [(i, c, t, 10 * i) for i, (c, t) in enumerate(zip(COLS, TYPES, strict=True))],
        "ordinal int, original_name string, inferred_type string, null_count bigint",
    )


def scored(spark, sf):
    return fnd.priority_scores(findings(spark, sf), columns(spark, sf), column_profile(spark), POPULATION)


def reviewed(spark, sf):
    return fnd.with_review_state(scored(spark, sf), _sql(spark, sf, REVIEWS))


@register("fnd_01", PRE + "SELECT finding_key, round(priority_score, 4) AS priority_score FROM scored")
def fnd_01(spark, sf):
    return scored(spark, sf).select("finding_key", F.round("priority_score", 4).alias("priority_score"))


@register("fnd_02", PRE + "SELECT finding_key, is_reinforced FROM re")
def fnd_02(spark, sf):
    return fnd.reinforced(columns(spark, sf))


# The whole list deducts far beyond 100, so runs of up to three findings are assessed as well.
_DEDUCT = "priority_score * 0.15 * CASE WHEN is_reinforced THEN 1.3 ELSE 1 END"
_LABEL = (
    "CASE WHEN score >= 90 THEN 'high_confidence' WHEN score >= 70 THEN 'usable_with_caution' "
    "WHEN score >= 40 THEN 'material_quality_concerns' ELSE 'not_reliable_for_decision_making' END AS label"
)


def _trust_sql(run: str, sql_from: str) -> str:
    return (
        f"SELECT {run} AS run, round(greatest(least(100 - sum({_DEDUCT}) - CASE WHEN bool_or(category = 'ai_processing_security') THEN 10 ELSE 0 END, 100), 0), 9) AS score, "
        f"count(*) AS finding_count, round(max(priority_score), 4) AS highest_priority_score FROM {sql_from} GROUP BY 1"
    )


@register(
    "fnd_03",
    PRE + ", rp AS (SELECT DISTINCT CAST(substr(finding_key, 2) AS BIGINT) // 3 AS run, finding_key, internal_key FROM fc), "
    "rc AS (SELECT run, internal_key, count(*) AS n FROM rp GROUP BY ALL), "
    "rr AS (SELECT finding_key, bool_or(n >= 2) AS is_reinforced FROM rp JOIN rc USING (run, internal_key) GROUP BY 1), "
    "t AS (" + _trust_sql("CAST(-1 AS BIGINT)", "scored LEFT JOIN re USING (finding_key)") + " UNION ALL "
    + _trust_sql("finding_index // 3", "scored LEFT JOIN rr USING (finding_key)")
    + f") SELECT run, CAST(round(score * 1000000) AS BIGINT) AS score_millionths, finding_count, highest_priority_score, {_LABEL} FROM t",
)
def fnd_03(spark, sf):
    """The whole list (run -1), and every run of up to three findings."""
    found, named = scored(spark, sf), columns(spark, sf)
    every = fnd.trust_assessment(found, named, samples_sent=True).select(F.lit(-1).cast("bigint").alias("run"), "*")
    run = F.floor(F.substring("finding_key", 2, 30).cast("bigint") / 3).cast("bigint")
    each = fnd.trust_assessment(found.withColumn("run", run), named.withColumn("run", run), samples_sent=True, by=("run",))
    return every.unionByName(each).select(
        "run", F.round(F.col("score") * 1_000_000).cast("bigint").alias("score_millionths"), "finding_count",
        F.round("highest_priority_score", 4).alias("highest_priority_score"), "label",
    )


@register(
    "fnd_04",
    PRE + "SELECT CASE WHEN priority_score >= 90 THEN 'high_confidence' WHEN priority_score >= 70 THEN 'usable_with_caution' "
    "WHEN priority_score >= 40 THEN 'material_quality_concerns' ELSE 'not_reliable_for_decision_making' END AS label, count(*) AS n "
    "FROM scored GROUP BY 1",
)
def fnd_04(spark, sf):
    return scored(spark, sf).groupBy(fnd.trust_label(F.col("priority_score")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "fnd_05",
    PRE + f", r AS ({ROWS}) SELECT CAST(40 AS BIGINT) AS row_count, CAST(5 AS BIGINT) AS column_count, (SELECT count(DISTINCT row_number) FROM r) AS rows_affected, "
    "(SELECT count(*) FROM f) AS findings_total, (SELECT count(*) FROM f WHERE affected_row_count = 0) AS findings_without_row_detail, "
    "CAST(200 AS BIGINT) AS cells_total, CAST(100 AS BIGINT) AS cells_missing, CAST(0.5 AS DOUBLE) AS missing_share",
)
def fnd_05(spark, sf):
    return fnd.dashboard_summary(findings(spark, sf), _sql(spark, sf, ROWS), column_profile(spark), POPULATION)


@register("fnd_06", f"SELECT count(DISTINCT row_number) AS rows_affected FROM ({ROWS})")
def fnd_06(spark, sf):
    return fnd.affected_rows(_sql(spark, sf, ROWS))


@register("fnd_07", PRE + "SELECT severity, count(*) AS n FROM f GROUP BY severity")
def fnd_07(spark, sf):
    return fnd.severity_distribution(findings(spark, sf))


@register("fnd_08", PRE + "SELECT category, count(*) AS n FROM f GROUP BY category")
def fnd_08(spark, sf):
    return fnd.category_distribution(findings(spark, sf))


@register(
    "fnd_09",
    PRE + "SELECT original_name, count(DISTINCT finding_key) AS n FROM fc GROUP BY 1 ORDER BY n DESC, original_name LIMIT 3",
)
def fnd_09(spark, sf):
    return fnd.columns_with_most_findings(columns(spark, sf), 3)


@register("fnd_10", PRE + "SELECT review_state, count(*) AS n FROM reviewed GROUP BY 1")
def fnd_10(spark, sf):
    return fnd.review_progress(reviewed(spark, sf))


@register(
    "fnd_11",
    PRE + ", names AS (SELECT finding_key, string_agg(original_name, ' ' ORDER BY position) AS names FROM fc GROUP BY 1) "
    "SELECT finding_key, severity, review_state FROM reviewed LEFT JOIN names USING (finding_key) WHERE category = 'ai_processing_security' "
    "AND review_state = 'unreviewed' AND contains(lower(concat_ws(' ', observation, names)), 'low unit')",
)
def fnd_11(spark, sf):
    return fnd.filter_findings(
        reviewed(spark, sf), columns(spark, sf), category="ai_processing_security", review_state="unreviewed", search=" LOW unit "
    ).select("finding_key", "severity", "review_state")


@register(
    "fnd_12",
    PRE + "SELECT finding_key, row_number() OVER (ORDER BY round(priority_score, 6) DESC, finding_index) AS place FROM scored",
)
def fnd_12(spark, sf):
    from rowlens.sources.rownum import number_rows

    exact = scored(spark, sf).withColumn("priority_score", F.round("priority_score", 6))
    ordered = number_rows(fnd.by_priority(exact), [F.desc("priority_score"), "finding_index"])
    return ordered.select("finding_key", (F.col("row_number") + 1).alias("place"))


@register(
    "fnd_13",
    PRE + ", o AS (SELECT finding_key, review_state, row_number() OVER (ORDER BY round(priority_score, 6) DESC, finding_index) AS position FROM reviewed), "
    "u AS (SELECT position, finding_key FROM o WHERE review_state = 'unreviewed') "
    "SELECT o.finding_key, o.position, lag(o.finding_key) OVER (ORDER BY o.position) AS previous_key, "
    "lead(o.finding_key) OVER (ORDER BY o.position) AS next_key, first_value(u.finding_key IGNORE NULLS) OVER (ORDER BY o.position "
    "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_unreviewed_key FROM o LEFT JOIN u ON o.position = u.position",
)
def fnd_13(spark, sf):
    return fnd.navigate(reviewed(spark, sf).withColumn("priority_score", F.round("priority_score", 6)))


@register(
    "fnd_14",
    f"SELECT finding_key, row_number, row_number() OVER w AS position, count(*) OVER (PARTITION BY finding_key) AS total, "
    f"lag(row_number) OVER w AS previous_row, lead(row_number) OVER w AS next_row FROM ({ROWS}) "
    "WINDOW w AS (PARTITION BY finding_key ORDER BY row_number)",
)
def fnd_14(spark, sf):
    return fnd.row_positions(_sql(spark, sf, ROWS), chunk=1000)


@register(
    "fnd_15",
    f"SELECT concat('f', CAST({K} AS STRING)) AS finding_key, p AS position, concat('e', CAST({K} + p AS STRING)) AS evidence_id, "
    f"o2.o_orderpriority AS payload FROM orders, (SELECT unnest([0, 1, 2]) AS p) JOIN (SELECT {K} AS k2, o_orderpriority FROM orders) o2 "
    f"ON o2.k2 = {K} + p",
)
def fnd_15(spark, sf):
    orders = load(spark, sf, "orders")
    lists = orders.selectExpr(
        f"concat('f', {K}) AS finding_key",
        f"array(concat('e', {K}), concat('e', {K} + 1), concat('e', {K} + 2)) AS evidence_ids",
    )
    evidence = orders.selectExpr(f"concat('e', {K}) AS evidence_id", "o_orderpriority AS payload")
    return fnd.finding_evidence(lists, evidence).select("finding_key", "position", "evidence_id", "payload")


@register("fnd_16", PRE + "SELECT finding_key, review_state FROM latest")
def fnd_16(spark, sf):
    return fnd.latest_reviews(_sql(spark, sf, REVIEWS)).select("finding_key", "review_state")


@register(
    "fnd_17",
    PRE + "SELECT finding_key, (SELECT count(*) FROM reviewed WHERE review_state = 'dismissed') AS omitted FROM reviewed "
    "WHERE review_state <> 'dismissed'",
)
def fnd_17(spark, sf):
    full = reviewed(spark, sf)
    omitted = fnd.dismissed_count(full).first()["omitted"]
    return fnd.visible_findings(full).select("finding_key", F.lit(omitted).cast("bigint").alias("omitted"))


@register(
    "fnd_18",
    PRE + "SELECT CASE review_state WHEN 'confirmed' THEN 'correct_at_source' WHEN 'needs_investigation' THEN 'investigate' "
    "ELSE 'review_pending' END AS bucket, count(*) AS n, CAST(sum(finding_index) AS BIGINT) AS index_sum FROM reviewed "
    "WHERE review_state <> 'dismissed' GROUP BY 1",
)
def fnd_18(spark, sf):
    buckets = fnd.recommendation_buckets(fnd.visible_findings(reviewed(spark, sf)))
    return buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("finding_index").alias("index_sum"))


_RULE = "CASE detector_id " + " ".join(
    f"WHEN '{d}' THEN {quote(TEMPLATES[d]['rule_type'])}" for d in DETECTORS[:-1]
) + f" ELSE {quote(GENERIC['rule_type'])} END"
_CHECK = "CASE detector_id " + " ".join(
    f"WHEN '{d}' THEN {quote(TEMPLATES[d]['rule_description'])}" for d in DETECTORS[:-1]
) + f" ELSE {quote(GENERIC['rule_description'])} END"


@register(
    "fnd_19",
    PRE + ", phrase AS (SELECT finding_key, string_agg(concat('''', original_name, ''''), ', ' ORDER BY position) AS p FROM fc GROUP BY 1) "
    f"SELECT finding_key, {_RULE} AS rule_type, replace({_CHECK}, '{{columns}}', coalesce(p, 'the affected columns')) AS rule_description "
    "FROM f LEFT JOIN phrase USING (finding_key)",
)
def fnd_19(spark, sf):
    return fnd.guidance(findings(spark, sf), columns(spark, sf)).select("finding_key", "rule_type", "rule_description")


_FRAMING = "CASE severity " + " ".join(f"WHEN '{s}' THEN {quote(t)}" for s, t in fnd.SEVERITY_FRAMING.items()) + " END"


@register(
    "fnd_20",
    PRE + f"SELECT finding_key, concat({_FRAMING}, ' Detector ''', detector_id, ''' (', category, ') reports: ', observation) AS narrative FROM f",
)
def fnd_20(spark, sf):
    return fnd.explanation(findings(spark, sf))
