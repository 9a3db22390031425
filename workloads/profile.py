"""AGG-01..23."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rowlens.operators import profile as prof
from rowlens.operators.cells import top_values, value_frequencies
from rowlens.operators.quantiles import exact_percentiles  # noqa: F401
from rowlens.sources.scratch import materialize
from workloads.base import *  # noqa: F403

AS_OF = dt.date(2000, 1, 1)
COLS = ["order_id", "priority", "answer", "mixed"]
VF = vf_sql("orders_view", COLS)
TOTALS = (
    "totals AS (SELECT ordinal, CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_count, "
    f"CAST(sum(CASE WHEN {s_bool('value')} THEN n ELSE 0 END) AS BIGINT) AS booleans, "
    f"CAST(sum(CASE WHEN ({s_day('value')}) IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS dates, "
    f"CAST(sum(CASE WHEN {s_num('value')} THEN n ELSE 0 END) AS BIGINT) AS numbers FROM vf GROUP BY ordinal)"
)


def _vf(spark, sf, view="orders_view", cols=COLS):
    return value_frequencies(view_table(spark, sf, view, cols))


@register("agg_01", VF + " SELECT ordinal, value, n, first_row FROM vf")
def agg_01(spark, sf):
    return _vf(spark, sf).select("ordinal", "value", "n", "first_row")


@register(
    "agg_02",
    f"{VF}, {TOTALS} SELECT ordinal, total AS non_null_count, distinct_count, "
    "(SELECT count(*) FROM orders) - total AS null_count FROM totals",
)
def agg_02(spark, sf):
    table = view_table(spark, sf, "orders_view", COLS)
    counts = value_frequencies(table).groupBy("ordinal").agg(
        F.sum("n").alias("non_null_count"), F.count(F.lit(1)).alias("distinct_count")
    )
    return counts.withColumn("null_count", F.lit(table.row_count).cast("bigint") - F.col("non_null_count"))


_TYPE = (
    "CASE WHEN booleans = total THEN 'boolean' WHEN dates = total THEN 'date' "
    "WHEN numbers = total THEN 'numeric' WHEN booleans + dates + numbers > 0 THEN 'mixed' "
    "WHEN total >= 2 AND distinct_count = total THEN 'identifier' "
    "WHEN distinct_count / total <= 0.5 THEN 'categorical' ELSE 'text' END"
)


@register("agg_03", f"{VF}, {TOTALS} SELECT ordinal, {_TYPE} AS inferred_type FROM totals")
def agg_03(spark, sf):
    p = prof.compute_profile(view_table(spark, sf, "orders_view", COLS), AS_OF)
    return p.column_profile.select("ordinal", "inferred_type")


@register(
    "agg_04",
    f"{VF}, {TOTALS} SELECT ordinal, printf('Column has a mix of value shapes: %d boolean-like, %d date-like, "
    "%d numeric-like, out of %d non-blank values', booleans, dates, numbers, total) AS warning "
    f"FROM totals WHERE {_TYPE} = 'mixed'",
)
def agg_04(spark, sf):
    p = prof.compute_profile(view_table(spark, sf, "orders_view", COLS), AS_OF)
    return p.column_profile.where("mixed_warning IS NOT NULL").select(
        "ordinal", F.col("mixed_warning").alias("warning")
    )


@register(
    "agg_05",
    f"{VF}, {TOTALS} SELECT ordinal, round(distinct_count / total, 6) AS uniqueness_ratio, 'string' AS source_type FROM totals",
)
def agg_05(spark, sf):
    p = prof.compute_profile(view_table(spark, sf, "orders_view", COLS), AS_OF)
    return p.column_profile.select(
        "ordinal", F.round("uniqueness_ratio", 6).alias("uniqueness_ratio"), "source_type"
    )


@register(
    "agg_06",
    VF + " SELECT ordinal, CAST(rank AS BIGINT) AS rank, value, n FROM (SELECT *, row_number() OVER "
    "(PARTITION BY ordinal ORDER BY n DESC, first_row) AS rank FROM vf) WHERE rank <= 5",
)
def agg_06(spark, sf):
    return top_values(_vf(spark, sf)).select("ordinal", big("rank"), "value", "n")


# --- numeric metrics over lineitem ------------------------------------------------------------

NUM = ["quantity", "unit_price", "discount_pct"]
_NUM_CELLS = " UNION ALL ".join(f"SELECT {i} AS ordinal, {c} AS v FROM src" for i, c in enumerate(NUM))
NSRC = f"WITH src AS ({view_sql('sales', NUM)}), cells AS ({_NUM_CELLS})"
QUART = (
    "q AS (SELECT ordinal, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, "
    "quantile_cont(v, 0.75) AS q3 FROM cells GROUP BY ordinal)"
)


def _numeric(spark, sf):
    return prof.compute_profile(view_table(spark, sf, "sales", NUM), AS_OF).column_profile


def _rounded(frame, names, places=4):
    return frame.select("ordinal", *[F.round(n, places).alias(n) for n in names])


@register(
    "agg_07",
    f"{NSRC} SELECT ordinal, round(min(v), 4) AS num_min, round(max(v), 4) AS num_max, round(avg(v), 4) AS mean, "
    "round(quantile_cont(v, 0.5), 4) AS median, round(stddev_samp(v), 4) AS stdev FROM cells GROUP BY ordinal",
)
def agg_07(spark, sf):
    return _rounded(_numeric(spark, sf), ["num_min", "num_max", "mean", "median", "stdev"])


@register(
    "agg_08",
    f"{NSRC}, {QUART} SELECT ordinal, round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3, "
    "round(q3 - q1, 4) AS iqr FROM q",
)
def agg_08(spark, sf):
    """Exact percentiles with the memory bound forced low, so the narrowing path runs."""
    table = view_table(spark, sf, "sales", NUM)
    values = materialize(value_frequencies(table).select("ordinal", F.col("num").alias("v"), "n"), "numbers")
    found = exact_percentiles(values, [0.25, 0.5, 0.75], small_group=2_000)
    rows = [(o, q[0], q[1], q[2], q[2] - q[0]) for o, q in found.items()]
    return _rounded(
        spark.createDataFrame(rows, "ordinal int, q1 double, q2 double, q3 double, iqr double"),
        ["q1", "q2", "q3", "iqr"],
    )


@register(
    "agg_09",
    f"{NSRC}, {QUART} SELECT c.ordinal, round(quantile_cont(abs(v - q2), 0.5), 4) AS mad FROM cells c "
    "JOIN q ON c.ordinal = q.ordinal GROUP BY c.ordinal",
)
def agg_09(spark, sf):
    return _rounded(_numeric(spark, sf), ["mad"])


@register(
    "agg_10",
    f"WITH src AS ({view_sql('orders_typed', ['o_orderkey', 'o_totalprice'])}) "
    "SELECT 0 AS ordinal, count(*) FILTER (o_orderkey = 0) AS zero_count, count(*) FILTER (o_orderkey < 0) AS negative_count FROM src "
    "UNION ALL SELECT 1, count(*) FILTER (o_totalprice = 0), count(*) FILTER (o_totalprice < 0) FROM src",
)
def agg_10(spark, sf):
    table = view_table(spark, sf, "orders_typed", ["o_orderkey", "o_totalprice"])
    return prof.compute_profile(table, AS_OF).column_profile.select("ordinal", "zero_count", "negative_count")


@register(
    "agg_11",
    f"{NSRC}, {QUART} SELECT c.ordinal, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) "
    "AS extreme_count FROM cells c JOIN q ON c.ordinal = q.ordinal GROUP BY c.ordinal",
)
def agg_11(spark, sf):
    return _numeric(spark, sf).select("ordinal", "extreme_count")


# --- dates ------------------------------------------------------------------------------------

DSRC = (
    f"WITH src AS ({view_sql('orders_view', ['day'])}), days AS "
    "(SELECT CAST(day AS DATE) AS d FROM src)"
)


def _dates(spark, sf):
    return prof.compute_profile(view_table(spark, sf, "orders_view", ["day"]), AS_OF).column_profile


@register(
    "agg_12",
    f"{DSRC} SELECT CAST(min(d) AS VARCHAR) AS date_min, CAST(max(d) AS VARCHAR) AS date_max, "
    "count(*) FILTER (d > DATE '2000-01-01') AS future_date_count, CAST(0 AS BIGINT) AS invalid_parse_count FROM days",
)
def agg_12(spark, sf):
    return _dates(spark, sf).select("date_min", "date_max", "future_date_count", "invalid_parse_count")


@register(
    "agg_13",
    f"{DSRC} SELECT CAST(max(gap) AS BIGINT) AS max_gap_days FROM (SELECT d - lag(d) OVER (ORDER BY d) AS gap "
    "FROM (SELECT DISTINCT d FROM days))",
)
def agg_13(spark, sf):
    return _dates(spark, sf).select(big("max_gap_days"))


# --- text -------------------------------------------------------------------------------------

TSRC = f"WITH src AS ({view_sql('texts', ['text'])})"


def _texts(spark, sf):
    return prof.compute_profile(view_table(spark, sf, "texts", ["text"]), AS_OF).column_profile


@register(
    "agg_14",
    f"{TSRC} SELECT CAST(min(length(text)) AS BIGINT) AS min_length, CAST(max(length(text)) AS BIGINT) AS max_length "
    "FROM src WHERE text <> ''",
)
def agg_14(spark, sf):
    return _texts(spark, sf).select(big("min_length"), big("max_length"))


@register(
    "agg_15",
    f"{TSRC} SELECT count(*) FILTER (text <> {s_strip('text')}) AS whitespace_issue_count, "
    f"count(*) FILTER ({s_strip('text')} = '') AS empty_string_count, "
    f"count(DISTINCT {s_key('text')}) AS normalized_distinct_count FROM src WHERE text <> ''",
)
def agg_15(spark, sf):
    return _texts(spark, sf).select(
        "whitespace_issue_count", "empty_string_count", "normalized_distinct_count"
    )


@register(
    "agg_16",
    f"{vf_sql('orders_view', ['order_id', 'priority'])} SELECT ordinal, count(*) / sum(n) >= 0.9 AS high_cardinality, "
    "count(*) / sum(n) >= 0.98 AND sum(n) >= 2 AS likely_identifier FROM vf GROUP BY ordinal",
)
def agg_16(spark, sf):
    table = view_table(spark, sf, "orders_view", ["order_id", "priority"])
    return prof.compute_profile(table, AS_OF).column_profile.select(
        "ordinal", "high_cardinality", "likely_identifier"
    )


@register(
    "agg_17",
    f"{TSRC} SELECT count(*) FILTER ({s_instruction('text')}) AS instruction_like_value_count FROM src",
)
def agg_17(spark, sf):
    return _texts(spark, sf).select("instruction_like_value_count")


# --- whole rows -------------------------------------------------------------------------------

ROWS = ["customer", "status", "gap"]
RSRC = f"WITH src AS ({view_sql('orders_rows', ROWS)})"


def _dataset(spark, sf, view="orders_rows", cols=ROWS):
    return prof.compute_profile(view_table(spark, sf, view, cols), AS_OF).dataset_profile


@register("agg_18", f"{RSRC} SELECT count(*) AS row_count, CAST(3 AS BIGINT) AS column_count FROM src")
def agg_18(spark, sf):
    return _dataset(spark, sf).select("row_count", big("column_count"))


@register(
    "agg_19",
    f"{RSRC} SELECT CAST(sum(coalesce(strlen(customer), 0) + coalesce(strlen(status), 0) + coalesce(strlen(gap), 0)) "
    "AS BIGINT) AS memory_estimate_bytes FROM src",
)
def agg_19(spark, sf):
    return _dataset(spark, sf).select("memory_estimate_bytes")


@register(
    "agg_20",
    f"WITH src AS ({view_sql('orders_copies')}) SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT a, b FROM src)) "
    "AS duplicate_row_count FROM src",
)
def agg_20(spark, sf):
    """A third of all rows are copies of one row."""
    groups = prof.duplicate_groups(view_table(spark, sf, "orders_copies"))
    return groups.agg(F.sum(F.col("copies") - 1).alias("duplicate_row_count"))


@register(
    "agg_21",
    f"{RSRC} SELECT count(*) FILTER ({s_missing('customer')} AND {s_missing('status')} AND {s_missing('gap')}) "
    "AS empty_row_count FROM src",
)
def agg_21(spark, sf):
    return _dataset(spark, sf).select("empty_row_count")


@register(
    "agg_22",
    f"WITH src AS ({view_sql('orders_view', ['answer', 'empty_col'])}) SELECT "
    "CAST((count(answer) = 0) AS BIGINT) + CAST((count(empty_col) = 0) AS BIGINT) AS empty_column_count FROM src",
)
def agg_22(spark, sf):
    return _dataset(spark, sf, "orders_view", ["answer", "empty_col"]).select(big("empty_column_count"))


_TYPED = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


@register(
    "agg_23",
    f"WITH src AS ({view_sql('orders_typed', _TYPED)}) SELECT 'o_custkey' AS original_name, 'numeric' AS inferred_type, "
    "count(DISTINCT o_custkey) AS distinct_count, round(avg(o_custkey), 4) AS mean, NULL::VARCHAR AS date_max, "
    "NULL::BIGINT AS max_length FROM src UNION ALL SELECT 'o_orderstatus', 'categorical', count(DISTINCT o_orderstatus), "
    "NULL, NULL, max(length(o_orderstatus)) FROM src UNION ALL SELECT 'o_totalprice', 'numeric', "
    "count(DISTINCT o_totalprice), round(avg(o_totalprice), 4), NULL, NULL FROM src UNION ALL "
    "SELECT 'o_orderdate', 'date', count(DISTINCT o_orderdate), NULL, CAST(max(o_orderdate) AS VARCHAR), NULL FROM src",
)
def agg_23(spark, sf):
    p = prof.compute_profile(view_table(spark, sf, "orders_typed", _TYPED), AS_OF)
    return p.column_profile.select(
        "original_name", "inferred_type", "distinct_count", F.round("mean", 4).alias("mean"), "date_max", big("max_length")
    )


