"""Scoring, finding lists, reviews and guidance (FND-01..20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlens.sources.rownum import ROW_NUMBER

# Scoring weights, bonuses and thresholds.
SEVERITY_WEIGHT = {"critical": 100.0, "high": 75.0, "medium": 50.0, "low": 25.0, "informational": 10.0}
MONETARY_MARKERS = (
    "price", "total", "amount", "cost", "revenue",
    "balance", "payment", "fee", "charge", "value",
)
ROW_BONUS_MAX = 15.0
ROLE_BONUS = 10.0
ROLE_BONUS_MAX = 15.0
DEDUCTION = 0.15
REINFORCEMENT = 1.3
EXPOSURE_PENALTY = 10.0
LABELS = (
    (90.0, "high_confidence"),
    (70.0, "usable_with_caution"),
    (40.0, "material_quality_concerns"),
)
LOWEST_LABEL = "not_reliable_for_decision_making"
SECURITY_CATEGORY = "ai_processing_security"

# Review states in display order.
REVIEW_STATES = ("unreviewed", "confirmed", "dismissed", "needs_investigation")

# The sentence each severity opens an explanation with.
SEVERITY_FRAMING = {
    "critical": "This is a critical-severity finding that likely requires immediate attention.",
    "high": "This is a high-severity finding that likely warrants prompt attention.",
    "medium": "This is a medium-severity finding worth reviewing.",
    "low": "This is a low-severity finding, included for completeness.",
    "informational": "This is an informational finding.",
}


def _case(c: Column, mapping: dict, default=None) -> Column:
    expr = reduce(lambda e, kv: e.when(c == kv[0], F.lit(kv[1])), mapping.items(), F)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def severity_rank(c: Column) -> Column:
    return _case(c, {s: i for i, s in enumerate(SEVERITY_WEIGHT)}, len(SEVERITY_WEIGHT))


def priority_scores(
    findings: DataFrame, finding_columns: DataFrame, column_profile: DataFrame, population: int
) -> DataFrame:
    """FND-01. The column profile has one row per column, so it is a map-side join."""
    name = F.lower("original_name")
    monetary = reduce(lambda a, b: a | b, [name.contains(m) for m in MONETARY_MARKERS])
    roles = (
        finding_columns.join(column_profile.select("ordinal", "inferred_type"), "ordinal", "left")
        .groupBy("finding_key")
        .agg(
            F.coalesce(F.bool_or(F.col("inferred_type").isin("identifier", "date")), F.lit(False)).alias("keyed"),
            F.bool_or(monetary).alias("monetary"),
        )
    )
    base = _case(F.col("severity"), SEVERITY_WEIGHT) * F.col("confidence")
    share = F.col("affected_row_count") / F.lit(population) if population > 0 else F.lit(0.0)
    role_bonus = F.least(
        F.when(F.col("keyed"), ROLE_BONUS).otherwise(0.0)
        + F.when(F.col("monetary"), ROLE_BONUS).otherwise(0.0),
        F.lit(ROLE_BONUS_MAX),
    )
    score = base + F.least(share * ROW_BONUS_MAX, F.lit(ROW_BONUS_MAX)) + role_bonus
    return findings.join(roles, "finding_key", "left").withColumn(
        "priority_score", F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0))
    ).drop("keyed", "monetary")


def reinforced(finding_columns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """FND-02: findings that share a column with another finding, within each of `by`.

    Counts per column are aggregated and joined back (one row per column), so a column that
    owns most findings never becomes one window partition.
    """
    pairs = finding_columns.select(*by, "finding_key", "internal_key").distinct()
    counts = pairs.groupBy(*by, "internal_key").agg(F.count(F.lit(1)).alias("n"))
    few = counts if by else F.broadcast(counts)  # one row per column of one table
    return (
        pairs.join(few, [*by, "internal_key"])
        .groupBy(*by, "finding_key")
        .agg(F.bool_or(F.col("n") >= 2).alias("is_reinforced"))
    )


def trust_label(score: Column) -> Column:
    """FND-04."""
    expr = reduce(lambda e, cut: e.when(score >= cut[0], cut[1]), LABELS, F)
    return expr.otherwise(LOWEST_LABEL)


def trust_assessment(
    scored: DataFrame, finding_columns: DataFrame, samples_sent: bool = False, by: tuple[str, ...] = ()
) -> DataFrame:
    """FND-03, one row; or one per `by` (such as analysis_id), columns that both tables have."""
    flagged = scored.join(reinforced(finding_columns, by), [*by, "finding_key"], "left")
    deduction = (
        F.col("priority_score")
        * DEDUCTION
        * F.when(F.col("is_reinforced"), REINFORCEMENT).otherwise(1.0)
    )
    exposed = F.coalesce(F.bool_or(F.col("category") == SECURITY_CATEGORY), F.lit(False))
    penalty = F.when(exposed & F.lit(samples_sent), EXPOSURE_PENALTY).otherwise(0.0)
    return (
        flagged.groupBy(*by).agg(
            F.coalesce(F.sum(deduction), F.lit(0.0)).alias("deduction"),
            penalty.alias("penalty"),
            F.count(F.lit(1)).alias("finding_count"),
            F.max("priority_score").alias("highest_priority_score"),
        )
        .withColumn(
            "score",
            # rounded, so that the order in which a sum is made never moves a score over a label's edge
            F.round(
                F.greatest(
                    F.least(F.lit(100.0) - F.col("deduction") - F.col("penalty"), F.lit(100.0)),
                    F.lit(0.0),
                ),
                9,
            ),
        )
        .select(*by, trust_label(F.col("score")).alias("label"), "score", "finding_count", "highest_priority_score")
    )


def affected_rows(finding_rows: DataFrame) -> DataFrame:
    """FND-06."""
    return finding_rows.agg(F.count_distinct(ROW_NUMBER).alias("rows_affected"))


def dashboard_summary(
    findings: DataFrame, finding_rows: DataFrame, column_profile: DataFrame, row_count: int
) -> DataFrame:
    """FND-05: three one-row aggregates, put together by one more."""
    cells = column_profile.agg(
        F.count(F.lit(1)).alias("column_count"),
        F.coalesce(F.sum("null_count"), F.lit(0)).alias("missing"),
    )
    counts = findings.agg(
        F.count(F.lit(1)).alias("findings_total"),
        F.count_if(F.col("affected_row_count") == 0).alias("findings_without_row_detail"),
    )
    total = F.lit(row_count) * F.col("column_count")
    stacked = cells.unionByName(counts, allowMissingColumns=True).unionByName(
        affected_rows(finding_rows), allowMissingColumns=True
    )
    joined = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    return joined.select(
        F.lit(row_count).cast("bigint").alias("row_count"),
        "column_count",
        "rows_affected",
        "findings_total",
        "findings_without_row_detail",
        total.cast("bigint").alias("cells_total"),
        F.least(F.col("missing"), total).alias("cells_missing"),
        F.when(total > 0, F.least(F.col("missing"), total) / total).alias("missing_share"),
    )


def severity_distribution(findings: DataFrame) -> DataFrame:
    """FND-07."""
    return (
        findings.groupBy("severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(severity_rank(F.col("severity")), "severity")
    )


def category_distribution(findings: DataFrame) -> DataFrame:
    """FND-08."""
    return (
        findings.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")
    )


def columns_with_most_findings(finding_columns: DataFrame, limit: int = 5) -> DataFrame:
    """FND-09: a top-k report."""
    return (
        finding_columns.select("finding_key", "original_name")
        .distinct()
        .groupBy("original_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "original_name")
        .limit(limit)
    )


def with_review_state(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with the latest review decision; none means unreviewed."""
    latest = latest_reviews(reviews)
    return findings.join(latest, "finding_key", "left").withColumn(
        "review_state", F.coalesce("review_state", F.lit(REVIEW_STATES[0]))
    )


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """FND-16: the last decision wins; a dismissal without a reason is refused."""
    valid = (F.col("review_state") != "dismissed") | (
        F.length(F.trim(F.coalesce("dismissal_reason", F.lit("")))) > 0
    )
    return (
        reviews.where(valid)
        .groupBy("finding_key")
        .agg(
            F.max_by(
                F.struct("review_state", "note", "dismissal_reason"),
                F.struct("reviewed_at", "review_state"),
            ).alias("r")
        )
        .select("finding_key", "r.*")
    )


def review_progress(reviewed: DataFrame) -> DataFrame:
    """FND-10, largest state first."""
    return (
        reviewed.groupBy("review_state")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "review_state")
    )


def filter_findings(
    reviewed: DataFrame,
    finding_columns: DataFrame,
    *,
    severity: str | None = None,
    category: str | None = None,
    review_state: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """FND-11. Every given condition must hold; the search looks at text and column names."""
    out = reviewed
    for name, wanted in (("severity", severity), ("category", category), ("review_state", review_state)):
        if wanted:
            out = out.where(F.col(name) == wanted)
    needle = (search or "").strip().lower()
    if needle:
        names = finding_columns.groupBy("finding_key").agg(
            # a finding names at most the columns of its table
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("position", "original_name"))),
                    lambda s: s["original_name"],
                ),
                " ",
            ).alias("names")
        )
        text = F.lower(F.concat_ws(" ", "observation", "names"))
        out = out.join(names, "finding_key", "left").where(text.contains(needle)).drop("names")
    return out


def by_priority(scored: DataFrame) -> DataFrame:
    """FND-12: highest score first, original order within a score."""
    return scored.orderBy(F.desc("priority_score"), "finding_index")


def navigate(scored: DataFrame) -> DataFrame:
    """FND-13: neighbours of every finding in priority order.

    Works on the ordered, numbered list of findings: position joins to position +- 1, and the
    next unreviewed position is a running minimum per block plus the first of later blocks.
    """
    from rowlens.sources.rownum import number_rows

    listed = number_rows(
        scored.select("finding_key", "review_state", "priority_score", "finding_index"),
        [F.desc("priority_score"), "finding_index"],
    ).withColumnRenamed(ROW_NUMBER, "position")
    block = 100_000
    blocked = listed.withColumn("block", F.floor(F.col("position") / block))
    inside = W.partitionBy("block").orderBy("position")
    # read backwards, the nearest later finding is the last one seen
    later = W.partitionBy("block").orderBy(F.desc("position")).rowsBetween(W.unboundedPreceding, -1)
    open_key = F.when(F.col("review_state") == "unreviewed", F.col("finding_key"))
    firsts = blocked.groupBy("block").agg(
        F.min_by("finding_key", F.when(F.col("review_state") == "unreviewed", F.col("position"))).alias("first_open"),
        F.min_by("finding_key", "position").alias("first_key"),
        F.max_by("finding_key", "position").alias("last_key"),
    )
    over_blocks = W.orderBy("block")
    edges = firsts.select(
        "block",
        F.lag("last_key").over(over_blocks).alias("before_block"),
        F.lead("first_key").over(over_blocks).alias("after_block"),
        F.last("first_open", ignorenulls=True)
        .over(W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1))
        .alias("open_after_block"),
    )
    return (
        blocked.withColumn("_prev", F.lag("finding_key").over(inside))
        .withColumn("_next", F.lead("finding_key").over(inside))
        .withColumn("_open", F.last(open_key, ignorenulls=True).over(later))
        .join(edges, "block")
        .select(
            "finding_key",
            (F.col("position") + 1).alias("position"),
            F.coalesce("_prev", "before_block").alias("previous_key"),
            F.coalesce("_next", "after_block").alias("next_key"),
            F.coalesce("_open", "open_after_block").alias("next_unreviewed_key"),
        )
    )


def row_positions(finding_rows: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """FND-14: place, neighbours and total of every affected row within its finding.

    A finding may name a third of all rows, so each finding is cut into chunks of row numbers;
    chunk totals and edge rows are stitched with one small row per chunk.
    """
    cut = finding_rows.withColumn("chunk", F.floor(F.col(ROW_NUMBER) / chunk))
    inside = W.partitionBy("finding_key", "chunk").orderBy(ROW_NUMBER)
    chunks = cut.groupBy("finding_key", "chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ROW_NUMBER).alias("first_row"),
        F.max(ROW_NUMBER).alias("last_row"),
    )
    per_finding = W.partitionBy("finding_key")
    ordered = per_finding.orderBy("chunk")
    edges = chunks.select(
        "finding_key",
        "chunk",
        F.coalesce(F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(per_finding).alias("total"),
        F.lag("last_row").over(ordered).alias("row_before"),
        F.lead("first_row").over(ordered).alias("row_after"),
    )
    return (
        cut.withColumn("_pos", F.row_number().over(inside))
        .withColumn("_prev", F.lag(ROW_NUMBER).over(inside))
        .withColumn("_next", F.lead(ROW_NUMBER).over(inside))
        .join(edges, ["finding_key", "chunk"])
        .select(
            "finding_key",
            ROW_NUMBER,
            (F.col("_pos") + F.col("before")).alias("position"),
            "total",
            F.coalesce("_prev", "row_before").alias("previous_row"),
            F.coalesce("_next", "row_after").alias("next_row"),
        )
    )


def finding_evidence(finding_evidence_ids: DataFrame, evidence: DataFrame) -> DataFrame:
    """FND-15: evidence of each finding in listed order; ids that resolve to nothing drop out."""
    listed = finding_evidence_ids.select(
        "finding_key", F.posexplode("evidence_ids").alias("position", "evidence_id")
    )
    return listed.join(evidence, "evidence_id")


def visible_findings(reviewed: DataFrame, include_dismissed: bool = False) -> DataFrame:
    """FND-17."""
    return reviewed if include_dismissed else reviewed.where(F.col("review_state") != "dismissed")


def dismissed_count(reviewed: DataFrame) -> DataFrame:
    return reviewed.agg(F.count_if(F.col("review_state") == "dismissed").alias("omitted"))


def recommendation_buckets(visible: DataFrame) -> DataFrame:
    """FND-18: one row per open finding with its bucket, in priority order within the bucket."""
    bucket = _case(
        F.col("review_state"),
        {"confirmed": "correct_at_source", "needs_investigation": "investigate", "unreviewed": "review_pending"},
    )
    return visible.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())


def columns_phrase(finding_columns: DataFrame, shown: int = 3, width: int = 60) -> DataFrame:
    """Up to three quoted column names per finding."""
    top = finding_columns.where(F.col("position") < shown)
    names = top.groupBy("finding_key").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", "original_name"))),
                lambda s: F.concat(F.lit("'"), F.substring(s["original_name"], 1, width), F.lit("'")),
            ),
            ", ",
        ).alias("names")
    )
    more = finding_columns.groupBy("finding_key").agg(F.count(F.lit(1)).alias("n"))
    return names.join(more, "finding_key").select(
        "finding_key",
        F.concat(
            "names", F.when(F.col("n") > shown, F.lit(" and other columns")).otherwise("")
        ).alias("columns_phrase"),
    )


def guidance(findings: DataFrame, finding_columns: DataFrame) -> DataFrame:
    """FND-19: impact, remediation and proposed rule per finding; the template table is small."""
    from rowlens.operators.guidance import GENERIC, template_frame

    templates = template_frame(findings.sparkSession)
    named = findings.join(columns_phrase(finding_columns), "finding_key", "left").withColumn(
        "columns_phrase", F.coalesce("columns_phrase", F.lit("the affected columns"))
    )
    joined = named.join(F.broadcast(templates), "detector_id", "left")
    filled = [
        F.replace(F.coalesce(c, F.lit(v)), F.lit("{columns}"), F.col("columns_phrase")).alias(c)
        for c, v in GENERIC.items()
    ]
    return joined.select("finding_key", "detector_id", *filled)


def explanation(findings: DataFrame) -> DataFrame:
    """FND-20."""
    framing = _case(F.col("severity"), SEVERITY_FRAMING, "This finding was flagged during analysis.")
    return findings.select(
        "finding_key",
        F.concat(
            framing, F.lit(" Detector '"), "detector_id", F.lit("' ("), "category",
            F.lit(") reports: "), "observation",
        ).alias("narrative"),
    )
