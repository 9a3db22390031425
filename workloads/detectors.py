"""DET-01..28."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rowlens.functions import security
from rowlens.operators import detectors as det
from rowlens.operators.detectors import groups, observations, structural, values
from rowlens.operators.detectors.base import Context
from rowlens.operators.profile import compute_profile
from rowlens.operators.table import Table
from workloads.base import *  # noqa: F403

AS_OF = dt.date(2026, 1, 1)


def detect(table: Table, *wanted, config=None, samples_sent=False):
    ctx = Context(compute_profile(table, AS_OF), samples_sent=samples_sent)
    return det.run_detectors(ctx, tuple(wanted), config)


def outcome(d, *payload: tuple[str, str]):
    """One row per finding: what, how severe, and exactly which rows (count and sum)."""
    named = d.finding_rows.groupBy("finding_key").agg(
        F.count(F.lit(1)).alias("rows_named"), F.sum("row_number").alias("row_sum")
    )
    column = d.finding_columns.where("position = 0").select("finding_key", F.col("original_name").alias("column_name"))
    return (
        d.findings.join(column, "finding_key", "left")
        .join(named, "finding_key", "left")
        .select(
            "column_name",
            "severity",
            "confidence",
            F.col("affected_row_count").alias("affected_rows"),
            "rows_named",
            "row_sum",
            *[
                F.round(F.get_json_object("payload", f"$.{k}").cast(t), 6).alias(k)
                if t == "double"
                else F.get_json_object("payload", f"$.{k}").cast(t).alias(k)
                for k, t in payload
            ],
        )
    )


def s_outcome(src: str, column: str | None, severity: str, confidence: float, hit: str, extra: str = "", having: str = "n > 0") -> str:
    """The same row from SQL for one column and one row predicate."""
    name = f"'{column}'" if column else "NULL::VARCHAR"
    inner = f"SELECT count(*) FILTER ({hit}) AS n, sum(row_number) FILTER ({hit}) AS s, count(*) AS total FROM src"
    return (
        f"WITH src AS ({src}), t AS ({inner}) SELECT {name} AS column_name, '{severity}' AS severity, "
        f"CAST({confidence} AS DOUBLE) AS confidence, n AS affected_rows, n AS rows_named, CAST(s AS BIGINT) AS row_sum"
        f"{', ' + extra if extra else ''} FROM t WHERE {having}"
    )


COPIES = view_sql("orders_copies")


@register(
    "det_01",
    f"WITH src AS ({COPIES}), g AS (SELECT a, b, count(*) AS n, sum(row_number) AS s FROM src GROUP BY a, b HAVING count(*) > 1) "
    "SELECT NULL::VARCHAR AS column_name, 'medium' AS severity, CAST(1.0 AS DOUBLE) AS confidence, CAST(sum(n) AS BIGINT) AS affected_rows, "
    "CAST(sum(n) AS BIGINT) AS rows_named, CAST(sum(s) AS BIGINT) AS row_sum, count(*) AS duplicate_group_count, "
    "CAST(sum(n) - count(*) AS BIGINT) AS duplicate_row_count FROM g",
)
def det_01(spark, sf):
    d = detect(view_table(spark, sf, "orders_copies"), structural.EXACT_DUPLICATE_ROWS)
    return outcome(d, ("duplicate_group_count", "bigint"), ("duplicate_row_count", "bigint"))


@register(
    "det_02",
    f"WITH src AS ({view_sql('orders_view', ['answer', 'empty_col'])}) SELECT 'empty_col' AS column_name, 'medium' AS severity, "
    "CAST(1.0 AS DOUBLE) AS confidence, CAST(0 AS BIGINT) AS affected_rows, NULL::BIGINT AS rows_named, NULL::BIGINT AS row_sum, "
    "count(*) - count(empty_col) AS null_count FROM src HAVING count(empty_col) = 0",
)
def det_02(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["answer", "empty_col"]), structural.EMPTY_COLUMN)
    return outcome(d, ("null_count", "bigint"))


@register(
    "det_03",
    s_outcome(view_sql("orders_view", ["priority"]), "priority", "medium", 1.0, s_missing("priority"),
              "round(n / total, 6) AS missing_ratio", "n / total >= 0.01"),
)
def det_03(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["priority", "answer"]), values.MISSING_VALUES)
    return outcome(d, ("missing_ratio", "double"))


@register(
    "det_04",
    s_outcome(view_sql("orders_view", ["order_id"]), "order_id", "high", 1.0, s_missing("order_id")),
)
def det_04(spark, sf):
    return outcome(detect(view_table(spark, sf, "orders_view", ["order_id", "priority"]), values.MISSING_IDENTIFIER))


def _s_groups(view: str, column: str, key: str, spelling: str, confidence: float, keep: str = "TRUE") -> str:
    return (
        f"WITH src AS ({view_sql(view, [column])}), v AS (SELECT row_number, {key} AS key, {spelling} AS spelling FROM src "
        f"WHERE NOT {s_blank(column)}) SELECT '{column}' AS column_name, 'low' AS severity, CAST({confidence} AS DOUBLE) AS confidence, "
        "count(*) AS affected_rows, count(*) AS rows_named, CAST(sum(row_number) AS BIGINT) AS row_sum, "
        f"count(DISTINCT spelling) AS variant_count FROM v WHERE {keep} GROUP BY key HAVING count(DISTINCT spelling) >= 2"
    )


@register("det_05", _s_groups("orders_view", "priority", s_key("priority"), s_strip("priority"), 1.0))
def det_05(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["priority"]), groups.CAPITALIZATION)
    return outcome(d, ("variant_count", "bigint"))


@register(
    "det_06",
    s_outcome(view_sql("orders_view", ["priority"]), "priority", "low", 1.0, f"priority <> {s_strip('priority')}"),
)
def det_06(spark, sf):
    return outcome(detect(view_table(spark, sf, "orders_view", ["priority", "answer"]), values.EDGE_WHITESPACE))


@register(
    "det_07",
    s_outcome(view_sql("orders_view", ["day"]), "day", "medium", 1.0, "CAST(day AS DATE) > DATE '2026-01-01'",
              "'2026-01-01' AS reference_date"),
)
def det_07(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["day"]), values.FUTURE_DATES)
    return outcome(d, ("reference_date", "string"))


@register(
    "det_08",
    s_outcome(view_sql("orders_typed", ["o_totalprice"]), "o_totalprice", "medium", 0.7, "o_totalprice < 0",
              "round(n / total, 6) AS negative_ratio", "n > 0 AND n / total < 0.1"),
)
def det_08(spark, sf):
    d = detect(view_table(spark, sf, "orders_typed", ["o_custkey", "o_totalprice"]), values.NEGATIVES)
    return outcome(d, ("negative_ratio", "double"))


_SALES = view_sql("sales")


def _sales_sql(checks: list[tuple[str, str, float, str]]) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, '{sev}' AS severity, CAST({conf} AS DOUBLE) AS confidence, "
        f"count(*) FILTER ({hit}) AS affected_rows, count(*) FILTER ({hit}) AS rows_named FROM src HAVING count(*) FILTER ({hit}) > 0"
        for c, sev, conf, hit in checks
    ]
    return f"WITH src AS ({_SALES}) " + union_sql(parts)


@register(
    "det_09",
    _sales_sql([(c, "medium", 1.0, f"{c} < 0 OR {c} > 100") for c in ("discount_pct", "tax_pct")]),
)
def det_09(spark, sf):
    d = detect(view_table(spark, sf, "sales", ["discount_pct", "tax_pct", "quantity"]), values.PERCENTAGES)
    return outcome(d).drop("row_sum")


@register(
    "det_10",
    _sales_sql([("quantity", "high", 1.0,
                 "abs(line_total - quantity * unit_price * (1 - discount_pct / 100) * (1 + tax_pct / 100)) > 0.015")]),
)
def det_10(spark, sf):
    return outcome(detect(view_table(spark, sf, "sales"), values.LINE_TOTAL)).drop("row_sum")


@register(
    "det_11",
    f"WITH src AS ({view_sql('orders_view', ['constant_col'])}) SELECT 'constant_col' AS column_name, 'medium' AS severity, "
    "CAST(1.0 AS DOUBLE) AS confidence, CAST(0 AS BIGINT) AS affected_rows, NULL::BIGINT AS rows_named, NULL::BIGINT AS row_sum, "
    "count(constant_col) AS non_null_count, min(constant_col) AS constant_value FROM src HAVING count(DISTINCT constant_col) = 1",
)
def det_11(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["constant_col", "answer"]), values.CONSTANT)
    return outcome(d, ("non_null_count", "bigint"), ("constant_value", "string"))


@register(
    "det_12",
    f"WITH src AS (SELECT CAST(c_custkey AS BIGINT) AS row_number, power(c_acctbal / 1000, 3) AS balance FROM customer), "
    "q AS (SELECT quantile_cont(balance, 0.25) AS q1, quantile_cont(balance, 0.75) AS q3 FROM src), "
    "f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) "
    "SELECT 'balance' AS column_name, 'medium' AS severity, CAST(0.7 AS DOUBLE) AS confidence, count(*) AS affected_rows, "
    "count(*) AS rows_named, CAST(sum(row_number) AS BIGINT) AS row_sum, round(any_value(lo), 6) AS lower_fence, "
    "round(any_value(hi), 6) AS upper_fence FROM src, f WHERE balance < lo OR balance > hi HAVING count(*) > 0",
)
def det_12(spark, sf):
    df = load(spark, sf, "customer").selectExpr("c_custkey AS row_number", "power(c_acctbal / 1000, 3) AS balance")
    d = detect(Table.from_dataframe(df), values.OUTLIERS)
    return outcome(d, ("lower_fence", "double"), ("upper_fence", "double"))


_ANY = " OR ".join(s_family("plain", f) for f in security.FAMILIES)
_TEXTS = f"SELECT row_number, {s_plain('text')} AS plain FROM ({view_sql('texts', ['text'])})"


def _injection_sql(samples_sent: bool) -> str:
    high, low = ("critical", "medium") if samples_sent else ("high", "low")
    fams = ", ".join(f"count(*) FILTER ({s_family('plain', f)}) AS f_{f}" for f in security.FAMILIES)
    hot = " + ".join(f"f_{f}" for f in security.HEIGHTENED)
    kinds = " + ".join(f"CAST(f_{f} > 0 AS INT)" for f in security.FAMILIES)
    return (
        f"WITH src AS ({_TEXTS}), t AS (SELECT {fams}, count(*) FILTER ({_ANY}) AS n, sum(row_number) FILTER ({_ANY}) AS s FROM src) "
        f"SELECT 'text' AS column_name, CASE WHEN {hot} > 0 THEN '{high}' ELSE '{low}' END AS severity, "
        f"CAST(CASE WHEN {kinds} >= 2 THEN 0.75 ELSE 0.6 END AS DOUBLE) AS confidence, n AS affected_rows, n AS rows_named, "
        "CAST(s AS BIGINT) AS row_sum FROM t WHERE n > 0"
    )


@register("det_13", _injection_sql(False))
def det_13(spark, sf):
    return outcome(detect(view_table(spark, sf, "texts"), values.INJECTION))


@register(
    "det_14",
    s_outcome(view_sql("orders_rows"), None, "low", 1.0,
              f"{s_blank('customer')} AND {s_blank('status')} AND {s_blank('gap')}"),
)
def det_14(spark, sf):
    return outcome(detect(view_table(spark, sf, "orders_rows"), structural.FULLY_EMPTY_ROWS))


@register(
    "det_15",
    s_outcome(view_sql("orders_view", ["answer"]), "answer", "low", 0.9, f"NOT {s_blank('answer')}"),
)
def det_15(spark, sf):
    return outcome(detect(view_table(spark, sf, "orders_view", ["answer", "priority"]), values.BOOLEANS))


@register(
    "det_16",
    s_outcome(view_sql("orders_view", ["day"]), "day", "low", 0.8, "CAST(day AS DATE) < DATE '1900-01-01'",
              "'1899-12-31' AS oldest_date_found"),
)
def det_16(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["day"]), values.OLD_DATES)
    return outcome(d, ("oldest_date_found", "string"))


@register(
    "det_17",
    s_outcome(view_sql("orders_view", ["email"]), "email", "low", 0.8,
              f"NOT {s_blank('email')} AND NOT {s_email(s_strip('email'))}", "total AS checked_value_count"),
)
def det_17(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["email", "priority"]), values.EMAILS)
    return outcome(d, ("checked_value_count", "bigint"))


@register(
    "det_18",
    s_outcome(view_sql("orders_view", ["amount"]), "amount", "medium", 0.9,
              f"{s_decorated('amount')} AND regexp_matches(amount, '[$€£¥%,]')", "total AS numeric_like_count"),
)
def det_18(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["amount", "priority"]), values.NUMBERS_AS_TEXT)
    return outcome(d, ("numeric_like_count", "bigint"))


@register(
    "det_19",
    _s_groups("orders_view", "priority", s_near(s_strip("priority")), s_key("priority"), 0.8,
              "length(key) >= 2 AND NOT regexp_matches(key, '^[0-9]+$')"),
)
def det_19(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["priority"]), groups.NEAR_DUPLICATES)
    return outcome(d, ("variant_count", "bigint"))


_NAMES = (
    "SELECT o_custkey AS dataset, o_orderkey AS ordinal, CASE o_orderkey % 3 WHEN 0 THEN upper(replace(o_orderpriority, '-', '_')) "
    "WHEN 1 THEN concat(o_orderpriority, '?') ELSE o_orderpriority END AS original_name FROM {orders}"
)


def _payload(path: str, kind: str):
    return F.get_json_object("payload", f"$.{path}").cast(kind)


_KEPT = "regexp_replace(lower(original_name), '[^0-9a-z]', '', 'g')"


@register(
    "det_20",
    f"WITH names AS ({_NAMES.format(orders='orders')}), wide AS (SELECT original_name, row_number() OVER (ORDER BY original_name) - 1 AS ordinal "
    "FROM (SELECT DISTINCT original_name FROM names)), listed AS (SELECT dataset, ordinal, original_name FROM names UNION ALL SELECT -1, ordinal, original_name FROM wide) "
    "SELECT dataset, count(*) AS column_count, "
    "count(DISTINCT original_name) = 1 AS identical, min(ordinal) AS first_ordinal FROM listed "
    f"GROUP BY dataset, {_KEPT} HAVING count(*) >= 2",
)
def det_20(spark, sf):
    """Column names of many datasets, one per customer; and the detector on a table (-1) that has each of these names once."""
    orders = load(spark, sf, "orders")
    orders.createOrReplaceTempView("rowlens_orders")
    names = spark.sql(_NAMES.format(orders="rowlens_orders"))
    many = structural.name_groups(names, ["dataset"]).select(
        "dataset", "column_count", (F.col("spellings") == 1).alias("identical"), "first_ordinal"
    )
    header = sorted(r[0] for r in names.select("original_name").distinct().collect())  # three forms of each priority
    wide = orders.select(*[F.col("o_orderstatus").alias(f"c{i}") for i in range(len(header))])
    found = detect(Table.from_dataframe(wide, names=header), structural.DUPLICATE_NAMES).findings
    return many.unionByName(found.select(
        F.lit(-1).cast("bigint").alias("dataset"), _payload("column_count", "bigint").alias("column_count"),
        _payload("identical_as_written", "boolean").alias("identical"), _payload("ordinals[0]", "bigint").alias("first_ordinal"),
    ))


@register(
    "det_21",
    "SELECT o_custkey AS dataset, 'high' AS severity, count(*) FILTER (o_orderstatus = 'P') AS row_count "
    "FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'P') = 0 "
    + "".join(f"UNION ALL SELECT {n}, 'high', count(*) FROM orders WHERE {w} HAVING count(*) = 0 " for n, w in ((-1, "o_totalprice < 0"), (-2, "o_totalprice >= 0"))),
)
def det_21(spark, sf):
    """Which datasets (the pending orders of each customer) have a header but no row; and the detector on orders below zero (-1) and others (-2)."""
    orders = load(spark, sf, "orders").withColumn("dataset", F.col("o_custkey"))
    out = structural.empty_datasets(orders, F.col("o_orderstatus") == "P")
    for n, part in ((-1, orders.where("o_totalprice < 0")), (-2, orders.where("o_totalprice >= 0"))):
        found = detect(Table.from_dataframe(part.select("o_orderkey", "o_orderstatus"), order_by=["o_orderkey"]), structural.EMPTY_DATASET).findings
        out = out.unionByName(found.select(F.lit(n).cast("bigint").alias("dataset"), "severity", _payload("row_count", "bigint").alias("row_count")))
    return out


# Ingest facts of many files: one file per customer, its orders are its warnings.
_WARN = (
    "CASE o_orderkey % 5 WHEN 0 THEN 'parsing.empty_column_name' WHEN 1 THEN 'parsing.ragged_row' "
    "WHEN 2 THEN 'parsing.xlsx_error_value' WHEN 3 THEN 'parsing.xlsx_formula_without_cached_value' ELSE 'parsing.other' END"
)


@register(
    "det_22",
    f"WITH w AS (SELECT o_custkey AS dataset, {_WARN} AS code FROM orders) SELECT dataset, count(*) AS unnamed_column_count, "
    "'medium' AS severity FROM w WHERE code = 'parsing.empty_column_name' GROUP BY dataset "
    "UNION ALL SELECT -1, count(DISTINCT o_orderstatus), 'medium' FROM orders",
)
def det_22(spark, sf):
    """Warnings of many files; and the detector on a file (-1) whose header has a blank cell for every order status."""
    from rowlens.sources.csv import ingest_facts, read_csv
    from rowlens.sources.scratch import scratch_path

    orders = load(spark, sf, "orders")
    warnings = orders.selectExpr("o_custkey AS dataset", f"{_WARN} AS code", "o_orderkey AS reference", "1 AS n")
    facts = ingest_facts(warnings, ["dataset"])
    many = facts.where(F.col("code") == "parsing.empty_column_name").select(
        "dataset", big("total", "unnamed_column_count"), F.lit("medium").alias("severity")
    )
    blanks = orders.select("o_orderstatus").distinct().count()
    path = scratch_path(spark, "unnamed")
    lines = orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("," * blanks)).alias("value"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = F.when(first, F.array(F.lit("key" + "," * blanks), "value")).otherwise(F.array("value"))
    lines.select(F.explode(header).alias("value")).write.text(path)  # every file starts with the header
    found = detect(read_csv(spark, path), structural.UNNAMED_COLUMN)
    named = found.finding_columns.groupBy("finding_key").agg(F.count(F.lit(1)).alias("unnamed_column_count"))
    return many.unionByName(found.findings.join(named, "finding_key").select(
        F.lit(-1).cast("bigint").alias("dataset"), "unnamed_column_count", "severity"
    ))


_RATIO = "least(ragged / row_count, 1.0)"


def _failures_sql() -> str:
    from workloads.io import SHAPE

    return (
        SHAPE + f", f AS (SELECT o_custkey AS dataset, count(*) * 4 AS row_count, count(*) FILTER ({_WARN} = 'parsing.ragged_row') AS ragged "
        "FROM orders GROUP BY 1), sh AS (SELECT h.sheet, any_value(last_row - header_row) AS row_count, count(DISTINCT row) FILTER (col >= 2) AS ragged, "
        "CAST(sum(DISTINCT row - header_row - 1) FILTER (col >= 2) AS BIGINT) AS row_sum, count(*) FILTER (type = 'e') AS errors "
        "FROM dec JOIN h ON h.sheet = dec.sheet GROUP BY h.sheet) "
        f"SELECT dataset, CASE WHEN {_RATIO} >= 0.5 THEN 'high' ELSE 'medium' END AS severity, "
        f"round({_RATIO}, 4) AS ragged_row_ratio, NULL::BIGINT AS unreadable_cells, NULL::BIGINT AS row_sum FROM f WHERE ragged >= 2 AND {_RATIO} >= 0.05 "
        "UNION ALL SELECT CASE sheet WHEN 's0' THEN -1 ELSE -2 END, CASE WHEN greatest(ragged / row_count, errors / (row_count * 2)) >= 0.5 THEN 'high' ELSE 'medium' END, "
        "round(ragged / row_count, 4), errors, row_sum FROM sh WHERE ragged >= 2 AND ragged / row_count >= 0.001"
    )


@register("det_23", _failures_sql())
def det_23(spark, sf):
    """Facts of many files; and the detector on two worksheets (-1, -2) with ragged rows and unreadable cells."""
    from rowlens.sources.grid import sheet_rows
    from workloads.io import decoded_cells

    warnings = load(spark, sf, "orders").selectExpr(
        "o_custkey AS dataset", f"{_WARN} AS code", "o_orderkey AS reference", "1 AS n"
    )
    facts = warnings.groupBy("dataset").agg(
        (F.count(F.lit(1)) * 4).alias("row_count"),
        F.count_if(F.col("code") == "parsing.ragged_row").alias("ragged_row_count"),
    )
    none = F.lit(None).cast("bigint")
    out = structural.parse_failure_frame(facts, minimum_count=2).select("*", none.alias("unreadable_cells"), none.alias("row_sum"))
    config = {structural.PARSE_FAILURES.id: {"row_ratio_threshold": 0.001, "minimum_count": 2}}
    for n, sheet in ((-1, "s0"), (-2, "s1")):
        table, _ = sheet_rows(decoded_cells(spark, sf), sheet)
        d = detect(table, structural.PARSE_FAILURES, config=config)
        rows = d.finding_rows.groupBy("finding_key").agg(F.sum("row_number").alias("row_sum"))
        out = out.unionByName(d.findings.join(rows, "finding_key").select(
            F.lit(n).cast("bigint").alias("dataset"), "severity", _payload("ragged_row_ratio", "double").alias("ragged_row_ratio"),
            _payload("error_value_cell_count", "bigint").alias("unreadable_cells"), "row_sum",
        ))
    return out


@register(
    "det_24",
    f"WITH src AS ({view_sql('orders_view', ['mixed'])}), s AS (SELECT {s_shape('mixed')} AS shape, count(*) AS n FROM src "
    f"WHERE NOT {s_missing('mixed')} GROUP BY 1) SELECT 'mixed' AS column_name, CAST(sum(n) AS BIGINT) AS non_blank_count, "
    "(SELECT shape FROM s ORDER BY n DESC, CASE shape WHEN 'boolean' THEN 0 WHEN 'date' THEN 1 WHEN 'numeric' THEN 2 ELSE 3 END LIMIT 1) "
    f"AS dominant_shape, CAST(max(CASE WHEN shape = 'text' THEN n END) AS BIGINT) AS text_count FROM s",
)
def det_24(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["mixed"]), observations.MIXED_TYPES)
    return d.observations.select(
        F.lit("mixed").alias("column_name"),
        F.get_json_object("payload", "$.non_blank_count").cast("bigint").alias("non_blank_count"),
        F.get_json_object("payload", "$.dominant_shape").alias("dominant_shape"),
        F.get_json_object("payload", "$.shape_counts.text").cast("bigint").alias("text_count"),
    )


@register(
    "det_25",
    f"WITH src AS ({view_sql('orders_view', ['written_day'])}), s AS (SELECT row_number, {s_date_family('written_day')} AS family FROM src), "
    "c AS (SELECT family, count(*) AS n FROM s GROUP BY 1), top AS (SELECT family FROM c WHERE family IS NOT NULL ORDER BY n DESC LIMIT 1), "
    "ex AS (SELECT row_number FROM s, top WHERE s.family <> top.family ORDER BY row_number LIMIT 20) "
    "SELECT CAST(sum(n) FILTER (family IS NOT NULL) AS BIGINT) AS date_like_count, CAST(sum(n) AS BIGINT) AS non_blank_count, "
    "(SELECT family FROM top) AS dominant_format, (SELECT CAST(sum(row_number) AS BIGINT) FROM ex) AS example_row_sum FROM c",
)
def det_25(spark, sf):
    d = detect(view_table(spark, sf, "orders_view", ["written_day"]), observations.DATE_FORMATS)
    rows = d.observation_rows.agg(F.sum("row_number")).first()[0]
    return d.observations.select(
        F.get_json_object("payload", "$.date_like_count").cast("bigint").alias("date_like_count"),
        F.get_json_object("payload", "$.non_blank_count").cast("bigint").alias("non_blank_count"),
        F.get_json_object("payload", "$.dominant_format").alias("dominant_format"),
        F.lit(rows).cast("bigint").alias("example_row_sum"),
    )


@register(
    "det_26",
    f"WITH src AS ({view_sql('orders_rows')}), kept AS (SELECT row_number, {s_missing('gap')} AS m, "
    "row_number() OVER (ORDER BY row_number) AS pos FROM src WHERE NOT (" +
    " AND ".join(s_blank(c) for c in ("customer", "status", "gap")) +
    ")), runs AS (SELECT count(*) AS len, min(row_number) AS a, max(row_number) AS b FROM (SELECT *, pos - row_number() OVER (ORDER BY pos) AS g "
    "FROM kept WHERE m) GROUP BY g) SELECT len AS longest_run_length, a AS first_row_number, b AS last_row_number, "
    "(SELECT count(*) FROM kept WHERE m) AS missing_count FROM runs ORDER BY len DESC, a LIMIT 1",
)
def det_26(spark, sf):
    """Chunks of 100 rows, so that the planted run crosses several chunk edges."""
    table = view_table(spark, sf, "orders_rows")
    runs = observations.missing_runs(table, [table.by_name("gap")], chunk=100)
    return runs.select(
        F.col("length").alias("longest_run_length"),
        F.col("first_row").alias("first_row_number"),
        F.col("last_row").alias("last_row_number"),
        "missing_count",
    )


@register(
    "det_27",
    "SELECT * FROM (VALUES "
    "('structural.empty_column', 'success', NULL::VARCHAR), "
    "('structural.unnamed_column', 'skipped', 'detector.skipped_ingest_facts_absent'), "
    "('cross_field.line_total_mismatch', 'success', 'cross_field.required_columns_not_found'), "
    "('consistency.inconsistent_date_formats', 'failed', NULL)) t(detector_id, status, warning)",
)
def det_27(spark, sf):
    d = detect(
        view_table(spark, sf, "orders_typed"),
        structural.EMPTY_COLUMN,
        structural.UNNAMED_COLUMN,
        values.LINE_TOTAL,
        observations.DATE_FORMATS,
        config={"consistency.inconsistent_date_formats": {"minimum_date_like_ratio": 2.0}},
    )
    return d.detector_runs.select("detector_id", "status", "warning")


@register("det_28", _injection_sql(True))
def det_28(spark, sf):
    return outcome(detect(view_table(spark, sf, "texts"), values.INJECTION, samples_sent=True))
