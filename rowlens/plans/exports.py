"""Export of validated rules (SNK-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_TYPE = "validation_rules"
EXPORT_SCHEMA_VERSION = "1"


def validated(rules: DataFrame) -> DataFrame:
    """Enabled rules whose latest execution ran without an error."""
    return rules.where(
        F.col("enabled") & F.col("pass_count").isNotNull() & F.col("error").isNull()
    )


OPTIONAL = ("description", "parameters", "provenance", "source_finding_ids")


def rules_export(rules: DataFrame, analysis_id: str) -> DataFrame:
    """SNK-01: one JSON document per validated rule, with the export's counts beside it.

    A document holds all a rule needs to run again; what the rules frame has no column for
    (`OPTIONAL`) and parameters that are null are left out.
    """
    ok = F.col("enabled") & F.col("pass_count").isNotNull() & F.col("error").isNull()
    counts = rules.agg(F.count_if(ok).alias("good"), F.count(F.lit(1)).alias("every")).first()
    columns = F.col("columns") if "columns" in rules.columns else F.array("column_name")
    document = F.to_json(
        F.struct(
            "rule_id", "name", *[c for c in OPTIONAL[:1] if c in rules.columns], "rule_type", "severity",
            columns.alias("columns"), "null_handling", *[c for c in OPTIONAL[1:] if c in rules.columns],
            F.struct("pass_count", "fail_count", "skipped_count").alias("validation"),
        )
    )
    return validated(rules).select(
        F.lit(EXPORT_TYPE).alias("export_type"),
        F.lit(EXPORT_SCHEMA_VERSION).alias("export_schema_version"),
        F.lit(analysis_id).alias("analysis_id"),
        F.lit(counts["good"]).cast("bigint").alias("rule_count"),
        F.lit(counts["every"] - counts["good"]).cast("bigint").alias("excluded_rule_count"),
        "rule_id",
        document.alias("document"),
    )


def write_rules_export(rules: DataFrame, analysis_id: str, path: str) -> None:
    rules_export(rules, analysis_id).write.mode("overwrite").json(path)
