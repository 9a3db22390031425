"""RUL-01..21."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rowlens.operators import rules as rul
from rowlens.operators.detectors import CATALOGUE, groups
from rowlens.operators.rules import Rule
from workloads.base import *  # noqa: F403
from workloads.detectors import detect

COUNTS = "pass_count", "fail_count", "skipped_count"


def run(table, *rules, examples=False):
    return rul.execute_rules(table, list(rules), examples)


def counts(result, *extra):
    return result.results.select("rule_id", *COUNTS, *extra)


def s_counts(rule_id: str, src: str, missing: str, fail: str, null_handling: str = "skip") -> str:
    """Status counts of a row-local rule."""
    if null_handling == "fail":
        status = f"CASE WHEN {missing} THEN 'f' WHEN {fail} THEN 'f' ELSE 'p' END"
    else:
        status = f"CASE WHEN {missing} THEN 's' WHEN {fail} THEN 'f' ELSE 'p' END"
    return (
        f"SELECT '{rule_id}' AS rule_id, count(*) FILTER (st = 'p') AS pass_count, count(*) FILTER (st = 'f') AS fail_count, "
        f"count(*) FILTER (st = 's') AS skipped_count FROM (SELECT {status} AS st FROM ({src}))"
    )


OV = view_sql("orders_view")
OT = view_sql("orders_typed")
SALES = view_sql("sales")


def _simple(name: str, view: str, cols: list[str], rule: Rule, sql: str) -> None:
    @register(name, sql)
    def go(spark, sf, view=view, cols=cols, rule=rule):
        return counts(run(view_table(spark, sf, view, cols), rule))


_simple(
    "rul_01", "orders_view", ["priority"], Rule("r", "not_null", ("priority",)),
    s_counts("r", OV, "FALSE", s_missing("priority")),
)
_simple(
    "rul_03", "orders_view", ["priority"],
    Rule("r", "accepted_values", ("priority",), accepted_values=("1-URGENT", "2-HIGH", "5-LOW")),
    s_counts("r", OV, s_missing("priority"), "priority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')"),
)
_simple(
    "rul_04", "orders_view", ["mixed"], Rule("r", "numeric_range", ("mixed",), minimum=100.0, maximum=900.0),
    s_counts("r", OV, s_missing("mixed"),
             f"({s_double('mixed')}) IS NULL OR ({s_double('mixed')}) < 100 OR ({s_double('mixed')}) > 900"),
)
_simple(
    "rul_05", "orders_view", ["written_day"],
    Rule("r", "date_range", ("written_day",), minimum_date=dt.date(1996, 1, 1), maximum_date=dt.date(2000, 1, 1)),
    s_counts("r", OV, s_missing("written_day"),
             f"({s_day('written_day')}) IS NULL OR ({s_day('written_day')}) < DATE '1996-01-01' OR ({s_day('written_day')}) > DATE '2000-01-01'"),
)
_simple(
    "rul_06", "orders_view", ["priority"], Rule("r", "regex", ("priority",), pattern=r"^\s|[0-9] "),
    s_counts("r", OV, s_missing("priority"), r"regexp_matches(priority, '^\s|[0-9] ')"),
)
_simple(
    "rul_07", "orders_view", ["priority"],
    Rule("r", "max_missing_percentage", ("priority",), threshold_percentage=5.0),
    s_counts("r", OV, "FALSE", s_missing("priority")),
)
_simple(
    "rul_09", "sales", ["quantity", "discount_pct", "tax_pct"],
    Rule("r", "approximate_equality", ("quantity", "discount_pct", "tax_pct"), tolerance=5.5),
    s_counts("r", SALES, "FALSE", "NOT abs(quantity - (discount_pct + tax_pct)) <= 5.5"),
)
_simple(
    "rul_12", "orders_view", ["priority"],
    Rule("r", "accepted_values", ("priority",), accepted_values=("1-URGENT",), null_handling="fail"),
    s_counts("r", OV, s_missing("priority"), "priority <> '1-URGENT'", "fail"),
)

_EXPR = [
    Rule("columns", "expression_comparison", ("discount_pct", "tax_pct"), comparison_operator="greater_than"),
    Rule("value", "expression_comparison", ("quantity",), comparison_operator="less_than_or_equal", comparison_value=40.0),
]


@register(
    "rul_10",
    s_counts("columns", SALES, "FALSE", "NOT discount_pct > tax_pct")
    + " UNION ALL " + s_counts("value", SALES, "FALSE", "NOT quantity <= 40"),
)
def rul_10(spark, sf):
    return counts(run(view_table(spark, sf, "sales", ["quantity", "discount_pct", "tax_pct"]), *_EXPR))


_COND = Rule(
    "r", "conditional_rule", ("o_custkey", "o_totalprice"), condition_operator="less_than",
    condition_value=700.0, comparison_operator="greater_than", comparison_value=100000.0,
)


@register("rul_11", s_counts("r", OT, "FALSE", "o_custkey < 700 AND NOT o_totalprice > 100000"))
def rul_11(spark, sf):
    return counts(run(view_table(spark, sf, "orders_typed", ["o_custkey", "o_totalprice"]), _COND))


OC = view_sql("orders_copies")
_KEYED = (
    f"WITH src AS ({OC}), g AS (SELECT a, b, count(*) AS n FROM src WHERE NOT {s_missing('a')} AND NOT {s_missing('b')} GROUP BY a, b), "
    f"m AS (SELECT count(*) AS n FROM src WHERE {s_missing('a')} OR {s_missing('b')}) "
)
_UNIQUE = Rule("r", "unique", ("a", "b"))


@register(
    "rul_02",
    _KEYED + "SELECT 'r' AS rule_id, count(*) FILTER (n = 1) AS pass_count, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS fail_count, "
    "(SELECT n FROM m) AS skipped_count FROM g",
)
def rul_02(spark, sf):
    return counts(run(view_table(spark, sf, "orders_copies"), _UNIQUE))


@register(
    "rul_08",
    _KEYED + ", c AS (SELECT count(*) FILTER (n = 1) AS p, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS f FROM g) "
    "SELECT 'r' AS rule_id, p AS pass_count, f AS fail_count, (SELECT n FROM m) AS skipped_count, "
    "f / (p + f) * 100 <= 50 AS within_threshold FROM c",
)
def rul_08(spark, sf):
    rule = Rule("r", "max_duplicate_percentage", ("a", "b"), threshold_percentage=50.0)
    return counts(run(view_table(spark, sf, "orders_copies"), rule), "within_threshold")


_R13 = [
    Rule("accepted", "accepted_values", ("priority",), accepted_values=("1-URGENT", "2-HIGH")),
    Rule("present", "not_null", ("priority",)),
    Rule("once", "unique", ("answer",)),
]


@register(
    "rul_13",
    f"WITH src AS ({OV}), f AS (SELECT 'accepted' AS rule_id, row_number, 'value is not an accepted value' AS reason FROM src "
    f"WHERE NOT {s_missing('priority')} AND priority NOT IN ('1-URGENT', '2-HIGH') UNION ALL SELECT 'present', row_number, 'value is missing' "
    f"FROM src WHERE {s_missing('priority')} UNION ALL SELECT 'once', row_number, printf('duplicate key shared with %d other row(s)', n - 1) "
    "FROM (SELECT row_number, count(*) OVER (PARTITION BY answer) AS n, min(row_number) OVER (PARTITION BY answer) AS g FROM src) WHERE g = 0) "
    "SELECT rule_id, CAST(position AS BIGINT) AS position, row_number, reason FROM (SELECT *, row_number() OVER (PARTITION BY rule_id "
    "ORDER BY row_number) AS position FROM f) WHERE position <= 10",
)
def rul_13(spark, sf):
    failures = run(view_table(spark, sf, "orders_view", ["priority", "answer"]), *_R13, examples=True).failures
    return failures.select("rule_id", big("position"), "row_number", "reason")


_R14 = [
    Rule("present", "not_null", ("priority",)),
    Rule("accepted", "accepted_values", ("answer",), accepted_values=("yes", "no")),
    Rule("range", "numeric_range", ("mixed",), minimum=0.0),
    Rule("unknown", "not_null", ("no_such_column",)),
    Rule("shapeless", "numeric_range", ("mixed",)),
]


@register(
    "rul_14",
    " UNION ALL ".join(
        f"SELECT *, FALSE AS has_error FROM ({q})"
        for q in (
            s_counts("present", OV, "FALSE", s_missing("priority")),
            s_counts("accepted", OV, s_missing("answer"), "answer NOT IN ('yes', 'no')"),
            s_counts("range", OV, s_missing("mixed"), f"({s_double('mixed')}) IS NULL OR ({s_double('mixed')}) < 0"),
        )
    )
    + " UNION ALL SELECT 'unknown', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), TRUE"
    + " UNION ALL SELECT 'shapeless', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), TRUE",
)
def rul_14(spark, sf):
    result = run(view_table(spark, sf, "orders_view", ["priority", "answer", "mixed"]), *_R14)
    return counts(result, F.col("error").isNotNull().alias("has_error"))


@register(
    "rul_15",
    f"SELECT rule_id, round(fail_count / (pass_count + fail_count), 6) AS fail_rate, "
    "fail_count / (pass_count + fail_count) * 100 <= 2.0 AS within_threshold FROM ("
    + s_counts("r", OV, "FALSE", s_missing("priority")) + ")",
)
def rul_15(spark, sf):
    rule = Rule("r", "max_missing_percentage", ("priority",), threshold_percentage=2.0)
    result = run(view_table(spark, sf, "orders_view", ["priority"]), rule).results
    return result.select("rule_id", F.round("fail_rate", 6).alias("fail_rate"), "within_threshold")


# --- proposals from real findings -------------------------------------------------------------

_PROPOSED = ("orders_view", "sales", "orders_copies")
_OFFERED = ("orders_view", "sales")
_TODAY, _OLDEST = "DATE '2026-01-01'", "DATE '1900-01-01'"


def _called_for() -> list[tuple[str, str, str, str, str, str, dict]]:
    """(view, finding, rule, test of the whole column, rows it skips, rows that fail, parameters) of every rule the views can call for."""
    out = []

    def add(view: str, finding: str, rule: str, having: str, skip: str, fail: str, **given: str) -> None:
        out.append((view, finding, rule, having, skip, fail, given))

    def times(condition: str) -> str:
        return f"count(*) FILTER ({condition})"

    for view in ("orders_view", "orders_copies"):
        for c in VIEWS[view][2]:
            missing = s_missing(c)
            gone, there, spaced = times(missing), times(f"NOT {missing}"), f"{c} <> {s_strip(c)}"
            add(view, f"structural.empty_column.{c}", "not_null", f"{there} = 0", "FALSE", missing)
            add(view, f"completeness.excessive_missing_values.{c}", "max_missing_percentage",
                f"{there} > 0 AND {gone} / count(*) >= 0.01", "FALSE", missing,
                threshold=f"round(100.0 * {gone} / count(*), 1)")
            add(view, f"consistency.leading_trailing_whitespace.{c}", "regex", f"{times(f'NOT {missing} AND {spaced}')} > 0",
                missing, spaced, pattern="TRUE")
            add(view, f"statistical.suspiciously_constant_column.{c}", "accepted_values",
                f"{there} >= 2 AND count(DISTINCT {c}) FILTER (NOT {missing}) = 1", missing, "FALSE",
                accepted=f"min({c}) FILTER (NOT {missing})")
    late, old, gone = f"CAST(day AS DATE) > {_TODAY}", f"CAST(day AS DATE) < {_OLDEST}", s_missing("order_id")
    add("orders_view", "completeness.missing_likely_identifier.order_id", "not_null", f"{times(gone)} > 0", "FALSE", gone)
    add("orders_view", "validity.future_dates.day", "date_range", f"{times(late)} > 0", "FALSE", late, maximum_date="'2026-01-01'")
    add("orders_view", "validity.implausibly_old_dates.day", "date_range", f"{times(old)} > 0", "FALSE", old, minimum_date="'1900-01-01'")
    add("orders_copies", "structural.exact_duplicate_rows.table", "unique", "count(*) > count(DISTINCT (a, b))", "FALSE", "NULL")
    for c in VIEWS["sales"][2]:
        q1, q3 = (f"quantile_cont({c}, {f})" for f in (0.25, 0.75))
        low, high = f"{q1} - 1.5 * ({q3} - {q1})", f"{q3} + 1.5 * ({q3} - {q1})"
        outside, negative = f"{c} < 0 OR {c} > 100", f"{c} < 0"
        if c.endswith("_pct"):
            add("sales", f"validity.invalid_percentages.{c}", "numeric_range", f"{times(outside)} > 0", "FALSE", outside,
                minimum="0", maximum="100")
        add("sales", f"validity.negative_likely_non_negative_values.{c}", "numeric_range", f"{times(negative)} > 0", "FALSE", negative,
            minimum="0")
        add("sales", f"statistical.extreme_outliers.{c}", "numeric_range", f"min({c}) < {low} OR max({c}) > {high}",
            "FALSE", f"{c} < (SELECT {low} FROM sales) OR {c} > (SELECT {high} FROM sales)",
            minimum=f"round({low}, 4)", maximum=f"round({high}, 4)")
    return out


def _over_views(parts: list[str]) -> str:
    views = ", ".join(f"{v} AS MATERIALIZED ({view_sql(v)})" for v in _PROPOSED)
    return f"WITH {views} " + " UNION ALL ".join(parts)


def _proposals_sql() -> str:
    unset = {"minimum": "NULL", "maximum": "NULL", "minimum_date": "NULL", "maximum_date": "NULL",
             "pattern": "FALSE", "threshold": "NULL", "accepted": "NULL"}
    parts = []
    for view, finding, rule, having, _, _, given in _called_for():
        x = unset | given
        parts.append(
            f"SELECT '{view}' AS view_name, '{finding}' AS finding_key, '{rule}' AS rule_type, CAST({x['minimum']} AS DOUBLE) AS minimum, "
            f"CAST({x['maximum']} AS DOUBLE) AS maximum, CAST({x['minimum_date']} AS VARCHAR) AS minimum_date, "
            f"CAST({x['maximum_date']} AS VARCHAR) AS maximum_date, {x['pattern']} AS has_pattern, "
            f"CAST({x['threshold']} AS DOUBLE) AS threshold_percentage, CAST({x['accepted']} AS VARCHAR) AS accepted_value "
            f"FROM {view} HAVING {having}"
        )
    return _over_views(parts)


def _offered_sql() -> str:
    parts = []
    for view, finding, _, having, skip, fail, _ in _called_for():
        if view in _OFFERED:
            status = f"CASE WHEN {skip} THEN 's' WHEN {fail} THEN 'f' ELSE 'p' END"
            fields = ", ".join(f"count(*) FILTER ({status} = '{c[0]}') AS {c}" for c in COUNTS)
            parts.append(f"SELECT 'proposed.{finding}' AS rule_id, {fields} FROM {view} HAVING {having}")
    return _over_views(parts)


@register("rul_16", _proposals_sql())
def rul_16(spark, sf):
    """Proposals of the whole catalogue on three whole views, which together call for every kind of rule."""
    out = None
    for view in _PROPOSED:
        found = rul.propose_rules(detect(view_table(spark, sf, view), *CATALOGUE).findings).where("rule_type IS NOT NULL")
        rows = found.select(
            F.lit(view).alias("view_name"), "finding_key", "rule_type", F.round("minimum", 4).alias("minimum"),
            F.round("maximum", 4).alias("maximum"), "minimum_date", "maximum_date",
            F.col("pattern").isNotNull().alias("has_pattern"), "threshold_percentage", "accepted_value",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "rul_17",
    f"WITH src AS ({view_sql('orders_view', ['priority'])}), v AS (SELECT DISTINCT {s_key('priority')} AS key, {s_strip('priority')} AS value "
    f"FROM src WHERE NOT {s_blank('priority')}) SELECT concat('consistency.inconsistent_capitalization.priority.', key) AS finding_key, value "
    "FROM v WHERE key IN (SELECT key FROM v GROUP BY key HAVING count(*) >= 2)",
)
def rul_17(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["priority"]), groups.CAPITALIZATION)
    return rul.casing_candidates(d.findings, d.finding_values).select("finding_key", "value")


@register("rul_18", _offered_sql())
def rul_18(spark, sf):
    """The rules that the whole catalogue offers on two whole views, run over all rows."""
    out = None
    for view in _OFFERED:
        table = view_table(spark, sf, view)
        d = detect(table, *CATALOGUE)
        rows = counts(rul.offer_rules(table, d.findings, d.finding_columns))
        out = rows if out is None else out.unionByName(rows)
    return out


_SPELLED = "consistency.inconsistent_capitalization.priority.5-low"
_CREATED = dt.datetime(2026, 1, 2, tzinfo=dt.UTC)
_MINE = Rule("mine", "accepted_values", ("priority",), accepted_values=("5-LOW", "2-HIGH"))


def _created(spark, sf):
    """A store with an analysis of the priorities, an own rule and one chosen from its spellings."""
    from rowlens.plans import RunStore, analyze
    from rowlens.sources.scratch import scratch_path

    table = view_table(spark, sf, "orders_view", ["priority"])
    store = RunStore(spark, scratch_path(spark, "store"))
    done = analyze(table, analysis_id="a1", as_of=dt.date(2026, 1, 1), detectors=(groups.CAPITALIZATION,))
    store.add(done, original_filename="orders.csv", dataset_format="csv", created_at=_CREATED)
    store.create_rule("a1", table, _MINE, at=_CREATED)
    chosen = Rule("chosen", "accepted_values", ("priority",), accepted_values=("5-LOW",))
    store.create_rule("a1", table, chosen, source_finding=_SPELLED, at=_CREATED)
    return store


@register(
    "rul_19",
    " UNION ALL ".join(
        s_counts(name, OV, s_missing("priority"), fail).replace(
            f"SELECT '{name}' AS rule_id", f"SELECT '{name}' AS rule_id, '{how}' AS provenance, count(*) FILTER (st = 'f') > 0 AS has_failing_rows"
        )
        for name, how, fail in (("mine", "user_authored", "priority NOT IN ('5-LOW', '2-HIGH')"), ("chosen", "ai_assisted", "priority <> '5-LOW'"))
    ),
)
def rul_19(spark, sf):
    """Rules created through the store and read back with their first result."""
    store = _created(spark, sf)
    failing = store.latest_failures("a1").select("rule_id", F.lit(True).alias("seen")).distinct()
    has = F.coalesce("seen", F.lit(False)).alias("has_failing_rows")
    return store.rules("a1").join(failing, "rule_id", "left").select("rule_id", "provenance", has, *COUNTS)


_TIDY = f"SELECT upper(trim(priority)) AS priority FROM ({view_sql('orders_view', ['priority'])})"


@register(
    "rul_20",
    "SELECT CAST(o_custkey AS VARCHAR) AS rule_id, max_by(o_orderkey % 7, o_orderkey) AS pass_count, max_by(o_orderkey % 3, o_orderkey) AS fail_count, "
    "max(o_orderkey) AS executed_at FROM orders GROUP BY o_custkey UNION ALL SELECT rule_id, pass_count, fail_count, 20260103 FROM ("
    + s_counts("mine", _TIDY, s_missing("priority"), "priority NOT IN ('5-LOW', '2-HIGH')")
    + ") UNION ALL SELECT rule_id, pass_count, fail_count, 20260102 FROM ("
    + s_counts("chosen", OV, s_missing("priority"), "priority <> '5-LOW'") + ")",
)
def rul_20(spark, sf):
    """Every order is one execution of its customer's rule; a stored rule is run again on tidied rows."""
    runs = load(spark, sf, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS rule_id", "o_orderkey % 7 AS pass_count", "o_orderkey % 3 AS fail_count",
        "0L AS skipped_count", "CAST(NULL AS STRING) AS error", "o_orderkey AS executed_at",
    )
    latest = rul.latest_results(runs).select("rule_id", "pass_count", "fail_count", "executed_at")
    store = _created(spark, sf)
    tidy = view_df(spark, sf, "orders_view", ["priority"]).withColumn("priority", F.upper(F.trim("priority")))
    store.rerun_rule("a1", rul.Table.from_dataframe(tidy), "mine", at=_CREATED + dt.timedelta(days=1))
    day = F.date_format("executed_at", "yyyyMMdd").cast("bigint").alias("executed_at")
    return latest.unionByName(store.rules("a1").select("rule_id", "pass_count", "fail_count", day))


@register(
    "rul_21",
    s_counts("canonical.consistency.inconsistent_capitalization.priority.5-low", OV, s_missing("priority"), "priority <> '5-LOW'"),
)
def rul_21(spark, sf):
    table = view_table(spark, sf, "orders_view", ["priority"])
    d = detect(table, groups.CAPITALIZATION)
    candidates = rul.casing_candidates(d.findings, d.finding_values)
    key = "consistency.inconsistent_capitalization.priority.5-low"
    return counts(run(table, rul.canonical_rule(candidates, d.finding_columns, key, "5-LOW")))
