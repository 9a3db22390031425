"""Validation rules (RUL-01..21): typed specs compiled to columns, executed over every row.

All row-local rules share one counting scan. Key rules (unique, duplicate share) aggregate
their key once. Failure examples come from a second scan limited to rules that failed.
"""

from __future__ import annotations

import datetime as dt
import re
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlens.functions import text
from rowlens.operators.table import ColumnRef, Table
from rowlens.sources.rownum import ROW_NUMBER

MAX_EXAMPLES = 10
MAX_PATTERN = 200
KEY_TYPES = ("unique", "max_duplicate_percentage")
# Columns and parameters each rule type takes (None: one or more columns).
RULE_SHAPES: dict[str, tuple[tuple[int, int | None], set[str]]] = {
    "not_null": ((1, 1), set()),
    "unique": ((1, None), set()),
    "accepted_values": ((1, 1), {"accepted_values"}),
    "numeric_range": ((1, 1), {"minimum", "maximum"}),
    "date_range": ((1, 1), {"minimum_date", "maximum_date"}),
    "regex": ((1, 1), {"pattern"}),
    "max_missing_percentage": ((1, 1), {"threshold_percentage"}),
    "max_duplicate_percentage": ((1, None), {"threshold_percentage"}),
    "approximate_equality": ((2, None), {"tolerance"}),
    "expression_comparison": ((1, 2), {"comparison_operator", "comparison_value"}),
    "conditional_rule": (
        (2, 2),
        {"condition_operator", "condition_value", "comparison_operator", "comparison_value"},
    ),
}
PARAMETERS = (
    "accepted_values", "minimum", "maximum", "minimum_date", "maximum_date", "pattern",
    "threshold_percentage", "tolerance", "comparison_operator", "comparison_value",
    "condition_operator", "condition_value",
)
# White space at either end, as a rule pattern.
_EDGE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
EDGE_SPACE = "".join(
    f"\\u{a:04x}" if a == b else f"\\u{a:04x}-\\u{b:04x}" for a, b in _EDGE_RANGES
)
WHITESPACE_PATTERN = rf"^[{EDGE_SPACE}]|[{EDGE_SPACE}]$"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_type: str
    columns: tuple[str, ...]
    name: str = ""
    description: str = ""
    severity: str = "medium"
    null_handling: str = "skip"
    enabled: bool = True
    accepted_values: tuple[str, ...] | None = None
    minimum: float | None = None
    maximum: float | None = None
    minimum_date: dt.date | None = None
    maximum_date: dt.date | None = None
    pattern: str | None = None
    threshold_percentage: float | None = None
    tolerance: float | None = None
    comparison_operator: str | None = None
    comparison_value: float | None = None
    condition_operator: str | None = None
    condition_value: float | None = None
    source_finding_ids: tuple[str, ...] = ()
    provenance: str = "user_authored"

    def problem(self) -> str | None:
        """Why the shape is not valid, or None."""
        if self.rule_type not in RULE_SHAPES:
            return f"unknown rule type {self.rule_type}"
        (low, high), owned = RULE_SHAPES[self.rule_type]
        if len(self.columns) < low or (high is not None and len(self.columns) > high):
            return f"{self.rule_type} does not take {len(self.columns)} column(s)"
        given = {p for p in PARAMETERS if getattr(self, p) is not None}
        if given - owned:
            return f"{self.rule_type} does not take {sorted(given - owned)}"
        if self.null_handling not in ("skip", "fail"):
            return "null_handling must be skip or fail"
        if self.rule_type == "accepted_values" and not self.accepted_values:
            return "accepted_values must not be empty"
        for a, b in (("minimum", "maximum"), ("minimum_date", "maximum_date")):
            if {a, b} <= owned:
                x, y = getattr(self, a), getattr(self, b)
                if x is None and y is None:
                    return f"{self.rule_type} needs a bound"
                if x is not None and y is not None and x > y:
                    return f"{a} must not exceed {b}"
        if self.rule_type == "regex":
            if not self.pattern or len(self.pattern) > MAX_PATTERN:
                return f"pattern must have 1 to {MAX_PATTERN} characters"
            try:
                re.compile(self.pattern)
            except re.error:
                return "pattern is not a regular expression"
        if "threshold_percentage" in owned and not (
            self.threshold_percentage is not None and 0 <= self.threshold_percentage <= 100
        ):
            return "threshold_percentage must be within 0-100"
        if "tolerance" in owned and (self.tolerance is None or self.tolerance < 0):
            return "tolerance must be zero or more"
        if self.rule_type == "expression_comparison":
            if self.comparison_operator is None:
                return "comparison_operator is required"
            if (len(self.columns) == 1) == (self.comparison_value is None):
                return "compare with either a second column or a value"
        if self.rule_type == "conditional_rule" and given != owned:
            return "conditional_rule needs both clauses"
        for op in (self.comparison_operator, self.condition_operator):
            if op is not None and op not in text.COMPARISONS:
                return f"unknown operator {op}"
        return None


def resolve(table: Table, rule: Rule) -> list[ColumnRef]:
    """RUL-19: columns by original name; an unknown name is an error."""
    refs = [table.by_name(name) for name in rule.columns]
    for name, ref in zip(rule.columns, refs, strict=True):
        if ref is None:
            raise ValueError(f"unknown column {name!r}")
    return refs


def _first(*cases: tuple[Column, str]) -> Column:
    """The first reason whose condition holds; null when the row passes."""
    return reduce(lambda e, c: e.when(c[0], F.lit(c[1])), cases, F)


def failure_reason(table: Table, rule: Rule) -> tuple[Column, Column]:
    """(skipped, reason) columns of a row-local rule; a null reason is a pass."""
    refs = resolve(table, rule)
    missing = [table.missing(c) for c in refs]
    first = refs[0]
    absent = "value is missing"
    if rule.rule_type in ("not_null", "max_missing_percentage"):
        return F.lit(False), _first((missing[0], absent))

    def handled(is_missing: Column, *cases: tuple[Column, str]) -> tuple[Column, Column]:
        """RUL-12: a missing cell is skipped or failed, before anything else is checked."""
        if rule.null_handling == "fail":
            return F.lit(False), _first((is_missing, absent), *cases)
        return is_missing, F.when(~is_missing, _first(*cases))

    if rule.rule_type == "accepted_values":
        known = table.text(first).isin(*rule.accepted_values)
        return handled(missing[0], (~known, "value is not an accepted value"))
    if rule.rule_type == "numeric_range":
        v = table.num(first)
        real = ~F.isnan(v)
        cases = [(v.isNull(), "value is not numeric")]
        if rule.minimum is not None:
            cases.append((real & (v < rule.minimum), "value is below the minimum"))
        if rule.maximum is not None:
            cases.append((real & (v > rule.maximum), "value is above the maximum"))
        return handled(missing[0], *cases)
    if rule.rule_type == "date_range":
        d = F.col(f"`{first.field}`") if first.kind == "date" else text.rule_date(table.text(first))
        cases = [(d.isNull(), "value is not an ISO-8601 date")]
        if rule.minimum_date is not None:
            cases.append((d < F.lit(rule.minimum_date), "date is before the minimum"))
        if rule.maximum_date is not None:
            cases.append((d > F.lit(rule.maximum_date), "date is after the maximum"))
        return handled(missing[0], *cases)
    if rule.rule_type == "regex":
        hit = table.text(first).rlike(rule.pattern)
        return handled(missing[0], (hit, "value matches the disallowed pattern"))
    numbers = [table.num(c) for c in refs]
    not_numeric = "value is not numeric"
    if rule.rule_type == "approximate_equality":
        parts = reduce(lambda a, b: a + b, numbers[1:])
        gap = F.abs(numbers[0] - parts)
        close = ~F.isnan(gap) & (gap <= rule.tolerance)
        return handled(
            text.any_of(missing),
            (text.any_of([n.isNull() for n in numbers]), not_numeric),
            (~close, "total differs from its components"),
        )
    if rule.rule_type == "expression_comparison":
        right = numbers[1] if len(numbers) == 2 else F.lit(float(rule.comparison_value))
        holds = text.compare(numbers[0], rule.comparison_operator, right)
        return handled(
            text.any_of(missing),
            (text.any_of([n.isNull() for n in numbers]), not_numeric),
            (~holds, "comparison is false"),
        )
    when, then = numbers
    applies = text.compare(when, rule.condition_operator, F.lit(float(rule.condition_value)))
    holds = text.compare(then, rule.comparison_operator, F.lit(float(rule.comparison_value)))
    then_missing = ~missing[0] & when.isNotNull() & applies & missing[1]
    reasons = [
        (when.isNull() & ~missing[0], "WHEN value is not numeric"),
        (~missing[0] & ~applies, None),
        (then.isNull() & ~missing[1], "THEN value is not numeric"),
        (~missing[0] & ~missing[1] & ~holds, "WHEN clause true but THEN clause is false"),
    ]
    return handled(F.coalesce(missing[0] | then_missing, F.lit(False)), *reasons)


def check_rows(table: Table, rules: list[Rule]) -> DataFrame:
    """RUL-01/03..07/09..12 per row: one status column (pass, fail, skip) per row-local rule."""
    columns = []
    for rule in rules:
        skipped, reason = failure_reason(table, rule)
        columns.append(
            F.when(skipped, "skip").when(reason.isNotNull(), "fail").otherwise("pass").alias(rule.rule_id)
        )
    return table.df.select(ROW_NUMBER, *columns)


@dataclass
class RuleRun:
    results: DataFrame  # rule_id, rule_type, pass/fail/skipped counts, fail_rate, error, duration_ms
    failures: DataFrame  # rule_id, position, row_number, reason
    rows: list[dict] = field(default_factory=list)


RESULT_SCHEMA = (
    "rule_id string, rule_type string, pass_count bigint, fail_count bigint, "
    "skipped_count bigint, fail_rate double, within_threshold boolean, error string, "
    "duration_ms int"
)
FAILURE_SCHEMA = f"rule_id string, position int, {ROW_NUMBER} bigint, reason string"


def _plain(table: Table, ref: ColumnRef) -> Column:
    """A key cell as it is compared: one zero and one NaN for numbers with a point."""
    value = F.col(f"`{ref.field}`")
    if table.df.schema[ref.field].dataType.typeName() not in ("float", "double"):
        return value
    return F.when(value == 0, F.lit(0.0)).when(F.isnan(value), F.lit(float("nan"))).otherwise(value)


def _key_entries(table: Table, rules: list[Rule]) -> DataFrame:
    """(row_number, rule, absent, h1, h2): every row once per key rule, its key as 128 bits.

    The table is read once for all rules, and only hashes leave it, however wide a key is.
    """
    marks = []
    for i, rule in enumerate(rules):
        refs = resolve(table, rule)
        absent = text.any_of([table.missing(c) for c in refs])
        key = [_plain(table, c) for c in refs]
        hashes = [F.when(~absent, F.xxhash64(F.lit(seed), *key)).otherwise(F.lit(0).cast("bigint")) for seed in (1, 2)]
        marks.append(F.struct(F.lit(i).alias("rule"), absent.alias("absent"), hashes[0].alias("h1"), hashes[1].alias("h2")))
    return table.df.select(ROW_NUMBER, F.inline(F.array(*marks)))


_KEY = ("rule", "absent", "h1", "h2")


def _key_groups(entries: DataFrame) -> DataFrame:
    """Rows per rule and key; a key that owns a third of them is combined before the shuffle."""
    return entries.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"), F.min(ROW_NUMBER).alias("first_row"))


def _run_key_rules(table: Table, rules: list[Rule]) -> dict[str, dict]:
    """RUL-02/08 for all key rules of a run in one aggregation; one row per rule reaches the driver."""
    copies, absent = F.col("copies"), F.col("absent")
    found = {
        r["rule"]: r
        for r in _key_groups(_key_entries(table, rules))
        .groupBy("rule")
        .agg(
            F.count_if(~absent & (copies == 1)).alias("passed"),
            F.coalesce(F.sum(F.when(~absent & (copies > 1), copies)), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(absent, copies)), F.lit(0)).alias("absent"),
        )
        .collect()
    }
    out = {}
    for i, rule in enumerate(rules):
        passed, failed, gone = (found[i][c] for c in ("passed", "failed", "absent")) if i in found else (0, 0, 0)
        fails = rule.null_handling == "fail"
        out[rule.rule_id] = {
            "pass_count": passed, "fail_count": failed + (gone if fails else 0), "skipped_count": 0 if fails else gone,
        }
    return out


def key_rule_failures(table: Table, rules: list[Rule]) -> DataFrame:
    """First failing rows of key rules: missing rows, then groups by first appearance.

    The ten earliest groups of a rule hold at least ten failing rows, so only they are joined back.
    """
    entries = _key_entries(table, rules)
    earliest = F.row_number().over(W.partitionBy("rule").orderBy("first_row"))
    first_groups = (
        _key_groups(entries).where(~F.col("absent") & (F.col("copies") > 1))
        .withColumn("_place", earliest).where(F.col("_place") <= MAX_EXAMPLES).drop("_place")
    )
    shared = F.format_string("duplicate key shared with %d other row(s)", F.col("copies") - 1)
    members = entries.join(F.broadcast(first_groups), list(_KEY)).select(
        "rule", F.lit(1).alias("stage"), "first_row", ROW_NUMBER, shared.alias("reason")
    )
    failing = [i for i, r in enumerate(rules) if r.null_handling == "fail"]
    if failing:
        members = members.unionByName(
            entries.where(F.col("absent") & F.col("rule").isin(failing)).select(
                "rule", F.lit(0).alias("stage"), F.col(ROW_NUMBER).alias("first_row"), ROW_NUMBER, F.lit("value is missing").alias("reason")
            )
        )
    place = F.row_number().over(W.partitionBy("rule").orderBy("stage", "first_row", ROW_NUMBER))
    names = F.array(*[F.lit(r.rule_id) for r in rules])
    return (
        members.withColumn("position", place)
        .where(F.col("position") <= MAX_EXAMPLES)
        .select(names[F.col("rule")].alias("rule_id"), F.col("position").cast("int").alias("position"), ROW_NUMBER, "reason")
    )


def row_rule_failures(table: Table, rules: list[Rule]) -> DataFrame:
    """RUL-13: the first ten failing rows of each rule, by a per-partition group limit."""
    marks = []
    for rule in rules:
        skipped, reason = failure_reason(table, rule)
        marks.append(
            F.when(
                ~skipped & reason.isNotNull(),
                F.struct(F.lit(rule.rule_id).alias("rule_id"), reason.alias("reason")),
            )
        )
    # inline drops rows without a failure; the marks are evaluated once per row
    failed = table.df.select(ROW_NUMBER, F.inline(F.array_compact(F.array(*marks))))
    rank = F.row_number().over(W.partitionBy("rule_id").orderBy(ROW_NUMBER))
    return (
        failed.withColumn("position", rank)
        .where(F.col("position") <= MAX_EXAMPLES)
        .select("rule_id", F.col("position").cast("int").alias("position"), ROW_NUMBER, "reason")
    )


def execute_rules(table: Table, rules: list[Rule], examples: bool = True) -> RuleRun:
    """RUL-14/15: every rule over every row; a rule that cannot run reports its error."""
    counted: dict[str, dict] = {}
    errors: dict[str, str] = {}
    local: list[Rule] = []
    keyed: list[Rule] = []
    started = time.perf_counter()
    for rule in rules:
        problem = rule.problem()
        try:
            if problem:
                raise ValueError(problem)
            resolve(table, rule)
        except ValueError as error:
            errors[rule.rule_id] = f"ValueError: {error}"
            continue
        (keyed if rule.rule_type in KEY_TYPES else local).append(rule)
    if local:
        try:
            counted.update(_count_local(table, local))
        except Exception:  # one bad rule (for example its pattern) must not hide the others
            for rule in local:
                try:
                    counted.update(_count_local(table, [rule]))
                except Exception as error:
                    errors[rule.rule_id] = type(error).__name__
    if keyed:
        try:
            counted.update(_run_key_rules(table, keyed))
        except Exception:  # a key that cannot be hashed, for example
            for rule in keyed:
                try:
                    counted.update(_run_key_rules(table, [rule]))
                except Exception as error:
                    errors[rule.rule_id] = type(error).__name__
    took = round((time.perf_counter() - started) * 1000)
    rows = [_result(rule, counted.get(rule.rule_id), errors.get(rule.rule_id), took) for rule in rules]
    results = table.spark.createDataFrame([tuple(r.values()) for r in rows], RESULT_SCHEMA)
    frames = []
    if examples:
        failing = {r["rule_id"] for r in rows if r["fail_count"]}
        wanted = [r for r in local if r.rule_id in failing]
        if wanted:
            frames.append(row_rule_failures(table, wanted))
        keys = [r for r in keyed if r.rule_id in failing]
        if keys:
            frames.append(key_rule_failures(table, keys))
    failures = (
        reduce(DataFrame.unionByName, frames)
        if frames
        else table.spark.createDataFrame([], FAILURE_SCHEMA)
    )
    return RuleRun(results, failures, rows)


def _count_local(table: Table, rules: list[Rule]) -> dict[str, dict]:
    status = check_rows(table, rules)
    row = status.agg(
        *[
            F.count_if(F.col(f"`{r.rule_id}`") == s).alias(f"{i}_{s}")
            for i, r in enumerate(rules)
            for s in ("pass", "fail", "skip")
        ]
    ).first()
    return {
        r.rule_id: {
            "pass_count": row[f"{i}_pass"],
            "fail_count": row[f"{i}_fail"],
            "skipped_count": row[f"{i}_skip"],
        }
        for i, r in enumerate(rules)
    }


def _result(rule: Rule, counts: dict | None, error: str | None, took: int) -> dict:
    c = counts or {"pass_count": 0, "fail_count": 0, "skipped_count": 0}
    judged = c["pass_count"] + c["fail_count"]
    rate = c["fail_count"] / judged if judged else None
    within = None
    if rule.threshold_percentage is not None and rate is not None:
        within = rate * 100 <= rule.threshold_percentage
    return {
        "rule_id": rule.rule_id,
        "rule_type": rule.rule_type,
        **c,
        "fail_rate": rate,
        "within_threshold": within,
        "error": error,
        "duration_ms": took,
    }


# --- proposals -----------------------------------------------------------------------------

GENERATABLE = (
    "structural.exact_duplicate_rows",
    "structural.empty_column",
    "completeness.excessive_missing_values",
    "completeness.missing_likely_identifier",
    "validity.future_dates",
    "validity.implausibly_old_dates",
    "validity.negative_likely_non_negative_values",
    "validity.invalid_percentages",
    "statistical.extreme_outliers",
    "consistency.leading_trailing_whitespace",
    "statistical.suspiciously_constant_column",
)
CHOICE_DETECTOR = "consistency.inconsistent_capitalization"


def propose_rules(findings: DataFrame) -> DataFrame:
    """RUL-16: one proposal per finding, parameters read from its evidence payload."""
    from rowlens.operators.guidance import RULE_TYPES

    kinds = findings.sparkSession.createDataFrame(
        [(d, RULE_TYPES[d]) for d in GENERATABLE], "detector_id string, rule_type string"
    )

    def payload(key: str) -> Column:
        return F.get_json_object("payload", f"$.{key}")

    def only(detector: str, value: Column) -> Column:
        return F.when(F.col("detector_id") == detector, value)

    zero = F.col("detector_id").isin(
        "validity.negative_likely_non_negative_values", "validity.invalid_percentages"
    )
    outlier = F.col("detector_id") == "statistical.extreme_outliers"
    return findings.join(F.broadcast(kinds), "detector_id", "left").select(
        "finding_key",
        "detector_id",
        "severity",
        "rule_type",
        F.when(zero, F.lit(0.0))
        .when(outlier, payload("lower_fence").try_cast("double"))
        .alias("minimum"),
        only("validity.invalid_percentages", F.lit(100.0)).alias("_max_pct"),
        F.when(outlier, payload("upper_fence").try_cast("double")).alias("_max_fence"),
        only("validity.implausibly_old_dates", payload("earliest_plausible_date")).alias("minimum_date"),
        only("validity.future_dates", payload("reference_date")).alias("maximum_date"),
        only("consistency.leading_trailing_whitespace", F.lit(WHITESPACE_PATTERN)).alias("pattern"),
        only(
            "completeness.excessive_missing_values",
            F.round(payload("missing_ratio").try_cast("double") * 100, 1),
        ).alias("threshold_percentage"),
        only("statistical.suspiciously_constant_column", payload("constant_value")).alias("accepted_value"),
        F.when(F.col("rule_type").isNull(), "no deterministic rule exists for this detector").alias("reason"),
    ).withColumn("maximum", F.coalesce("_max_pct", "_max_fence")).drop("_max_pct", "_max_fence")


def proposal_rules(proposals: DataFrame, finding_columns: DataFrame, table: Table) -> list[Rule]:
    """Proposals as rules. They come from column-level findings only, so there are few."""
    names = {
        r.finding_key: [n.original_name for n in sorted(r.cols, key=lambda c: c.position)]
        for r in finding_columns.join(
            proposals.where(F.col("rule_type").isNotNull()).select("finding_key"), "finding_key", "left_semi"
        )
        .groupBy("finding_key")
        .agg(F.collect_list(F.struct("position", "original_name")).alias("cols"))
        .collect()
    }
    rules = []
    for p in proposals.where(F.col("rule_type").isNotNull()).collect():
        whole_row = p.detector_id == "structural.exact_duplicate_rows"
        columns = [c.original_name for c in table.columns] if whole_row else names[p.finding_key]
        rules.append(
            Rule(
                rule_id=f"proposed.{p.finding_key}".replace("`", ""),
                rule_type=p.rule_type,
                columns=tuple(columns),
                name=f"Proposed for {p.detector_id}",
                severity=p.severity,
                minimum=p.minimum,
                maximum=p.maximum,
                minimum_date=dt.date.fromisoformat(p.minimum_date) if p.minimum_date else None,
                maximum_date=dt.date.fromisoformat(p.maximum_date) if p.maximum_date else None,
                pattern=p.pattern,
                threshold_percentage=p.threshold_percentage,
                accepted_values=(p.accepted_value,) if p.accepted_value is not None else None,
                source_finding_ids=(p.finding_key,),
                provenance="detector_generated",
            )
        )
    return rules


def offer_rules(table: Table, findings: DataFrame, finding_columns: DataFrame) -> RuleRun:
    """RUL-18: propose for every finding and execute all proposals together; nothing is stored."""
    return execute_rules(table, proposal_rules(propose_rules(findings), finding_columns, table))


def casing_candidates(findings: DataFrame, finding_values: DataFrame) -> DataFrame:
    """RUL-17: the closed list of spellings a canonical value may be chosen from."""
    eligible = findings.where(F.col("detector_id") == CHOICE_DETECTOR).select("finding_key")
    values = finding_values.join(eligible, "finding_key", "left_semi")
    sizes = values.groupBy("finding_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    return values.join(sizes.select("finding_key"), "finding_key", "left_semi")


def canonical_rule(
    candidates: DataFrame, finding_columns: DataFrame, finding_key: str, chosen: str
) -> Rule:
    """RUL-21: an accepted-values rule for a chosen spelling, which must be a candidate."""
    mine = candidates.where((F.col("finding_key") == finding_key) & (F.col("value") == chosen))
    if mine.isEmpty():
        raise ValueError(f"{chosen!r} is not one of the spellings of this finding")
    column = finding_columns.where(F.col("finding_key") == finding_key).first()["original_name"]
    return Rule(
        rule_id=f"canonical.{finding_key}",
        rule_type="accepted_values",
        columns=(column,),
        name="Canonical spelling",
        accepted_values=(chosen,),
        source_finding_ids=(finding_key,),
        provenance="ai_assisted",
    )


def provenance_of(rule: Rule, source_detector: str | None, candidates: tuple[str, ...] = ()) -> str:
    """RUL-19: how a stored rule came to exist; a false claim is refused."""
    if source_detector is None:
        return "user_authored"
    if source_detector != CHOICE_DETECTOR:
        return "detector_generated"
    genuine = (
        rule.rule_type == "accepted_values"
        and rule.accepted_values is not None
        and len(rule.accepted_values) == 1
        and rule.accepted_values[0] in candidates
    )
    if not genuine:
        raise ValueError("the rule does not match a candidate spelling of its finding")
    return "ai_assisted"


def latest_results(results: DataFrame) -> DataFrame:
    """RUL-20: the latest stored result per rule."""
    payload = F.struct("pass_count", "fail_count", "skipped_count", "error", "executed_at")
    return results.groupBy("rule_id").agg(F.max_by(payload, "executed_at").alias("r")).select("rule_id", "r.*")
