"""SRC-01..15 and SNK-01..04, on files Spark writes from the given tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from rowlens.operators.rules import Rule
from rowlens.plans import RunStore, analyze
from rowlens.plans.exports import rules_export
from rowlens.plans.report import FileFacts, freeze_report, report_lines
from rowlens.sources import csv, demo, grid
from rowlens.sources.headers import header_warnings, normalize_headers
from rowlens.sources.rownum import number_file_rows, number_rows
from rowlens.sources.scratch import scratch_path
from workloads.base import *  # noqa: F403

K = "o_orderkey"
CUT = csv.Limits(max_field_length=10_000)


def _write_csv(df, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    return path


def _documents_csv(spark, sf):
    return _write_csv(load(spark, sf, "documents").select("doc_id", "text", "lang"), "docs")


@register("src_01", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang FROM documents")
def src_01(spark, sf):
    """Texts with quotes and line breaks inside fields."""
    table = csv.read_csv(spark, _documents_csv(spark, sf))
    return table.df.select("doc_id", F.md5("text").alias("text_md5"), "lang")


HEADER_LINE = (
    f"concat('id', d, o_orderpriority, d, 'a,b;c', CASE WHEN {K} % 5 = 0 THEN ',,,' ELSE '' END, d, o_orderstatus)"
)
HEADERS = (
    f"SELECT {K}, {HEADER_LINE} AS line FROM (SELECT *, CASE {K} % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE chr(9) END AS d FROM orders)"
)


def _s_count(ch: str) -> str:
    return f"(length(line) - length(replace(line, {ch}, '')))"


_COUNTS = [_s_count(c) for c in ("','", "';'", "chr(9)", "'|'")]
_BEST = f"greatest({', '.join(_COUNTS)})"


@register(
    "src_02",
    f"WITH h AS ({HEADERS}) SELECT CASE WHEN {_BEST} = 0 THEN 'comma' WHEN {_COUNTS[0]} = {_BEST} THEN 'comma' WHEN {_COUNTS[1]} = {_BEST} THEN 'semicolon' "
    f"WHEN {_COUNTS[2]} = {_BEST} THEN 'tab' ELSE 'bar' END AS delimiter, count(*) AS n, CAST(sum({K}) AS BIGINT) AS key_sum FROM h GROUP BY 1",
)
def src_02(spark, sf):
    """One header line per order, as if each were a file."""
    load(spark, sf, "orders").createOrReplaceTempView("rowlens_orders")
    lines = spark.sql(HEADERS.replace("FROM orders", "FROM rowlens_orders"))
    name = F.create_map(*[F.lit(x) for x in (",", "comma", ";", "semicolon", "\t", "tab", "|", "bar")])
    picked = lines.withColumn("delimiter", name[csv.pick_delimiter(F.col("line"))])
    return tally(picked, ["delimiter"], K)


NAMES = (
    f"SELECT o_custkey AS file, {K} AS ordinal, CASE {K} % 6 WHEN 0 THEN '' WHEN 1 THEN upper(o_orderpriority) WHEN 2 THEN '  ?? ' ELSE o_orderpriority END AS name FROM orders"
)
_BASE = "CASE WHEN b = '' THEN 'column' ELSE b END"


@register(
    "src_03",
    f"WITH n AS ({NAMES}), d AS (SELECT file, ordinal, name = '' AS was_empty, CASE WHEN name = '' THEN concat('column_', CAST(ordinal AS VARCHAR)) ELSE name END AS original_name FROM n), "
    "k AS (SELECT *, regexp_replace(regexp_replace(lower(trim(original_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS b FROM d), "
    f"s AS (SELECT *, {_BASE} AS base, row_number() OVER (PARTITION BY file, {_BASE} ORDER BY ordinal) AS nth FROM k) "
    "SELECT CAST(file AS VARCHAR) AS file, CAST(ordinal AS BIGINT) AS ordinal, original_name, CASE WHEN nth = 1 THEN base ELSE concat(base, '_', CAST(nth AS VARCHAR)) END AS internal_key, "
    "was_empty, nth > 1 AS was_duplicate FROM s",
)
def src_03(spark, sf):
    """One header per customer, its orders being the cells."""
    load(spark, sf, "orders").createOrReplaceTempView("rowlens_orders")
    headers = spark.sql(NAMES.replace("FROM orders", "FROM rowlens_orders")).withColumn("file", F.col("file").cast("string"))
    return normalize_headers(headers).select(
        "file", big("ordinal"), "original_name", "internal_key", "was_empty", "was_duplicate"
    )


# Lines of a ragged file: short, long and blank ones among complete ones.
LINE = (
    f"CASE WHEN {K} % 101 = 0 THEN '' WHEN {K} % 50 = 7 THEN CAST({K} AS STRING) WHEN {K} % 77 = 5 THEN concat(CAST({K} AS STRING), ',', o_orderstatus, ',x,y') "
    f"WHEN {K} % 9 = 0 THEN concat(CAST({K} AS STRING), ',,', o_orderstatus) ELSE concat(CAST({K} AS STRING), ',\"', o_orderpriority, ', \"\"q\"\"\",', o_orderstatus) END"
)


def _ragged_file(spark, sf):
    """One file per partition, each with its header line; rows in key order."""
    path = scratch_path(spark, "ragged")
    lines = load(spark, sf, "orders").orderBy(K).selectExpr(f"{LINE} AS line")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    with_header = lines.withColumn("first", first).select(
        F.explode(F.when(F.col("first"), F.array(F.lit("key,label,"), "line")).otherwise(F.array("line"))).alias("value")
    )
    with_header.write.text(path)
    return path


@register(
    "src_04",
    f"SELECT {K} AS row_number, CASE WHEN {K} % 101 = 0 THEN NULL ELSE CAST({K} AS VARCHAR) END AS key, CASE WHEN {K} % 101 = 0 OR {K} % 50 = 7 THEN NULL "
    f"WHEN {K} % 77 = 5 THEN o_orderstatus WHEN {K} % 9 = 0 THEN '' ELSE concat(o_orderpriority, ', \"q\"') END AS label, "
    f"CASE WHEN {K} % 101 = 0 OR {K} % 50 = 7 THEN NULL WHEN {K} % 77 = 5 THEN 'x' ELSE o_orderstatus END AS column_2 FROM orders",
)
def src_04(spark, sf):
    return csv.read_csv(spark, _ragged_file(spark, sf)).df.select("row_number", "key", "label", "column_2")


@register(
    "src_05",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(substr(text, 1, 10000)) AS text_md5, CAST(least(length(text), 10000) AS BIGINT) AS kept FROM documents",
)
def src_05(spark, sf):
    table = csv.read_csv(spark, _documents_csv(spark, sf), limits=CUT)
    return table.df.select("doc_id", F.md5("text").alias("text_md5"), big(F.length("text"), "kept"))


# as many files as 10,000 customers each need, and four more
_DEALT = "o_custkey % (SELECT CAST(floor(count(*) / 10000) AS BIGINT) + 4 FROM customer)"
FILES = f"SELECT {_DEALT} AS d, {K} AS k, {LINE} AS line FROM orders"

# Files of two delimiters, with line breaks inside fields and, in some, inside the header; d % 4 = 2 has a blank header.
_OWN = "CASE WHEN d % 2 = 0 THEN ',' ELSE ';' END"
_SHAPE_OF = "CASE WHEN k % 101 = 0 THEN 0 WHEN k % 50 = 7 THEN 1 WHEN k % 77 = 5 THEN 4 ELSE 3 END"
MIXED = (
    f"SELECT d, k, CASE WHEN k % 101 = 0 THEN '' WHEN k % 50 = 7 THEN CAST(k AS STRING) WHEN k % 77 = 5 THEN concat(CAST(k AS STRING), s, o_orderstatus, s, 'x', s, 'y') "
    "WHEN k % 9 = 0 THEN concat(CAST(k AS STRING), s, s, o_orderstatus) ELSE concat(CAST(k AS STRING), s, '\"', o_orderpriority, ',;', chr(10), '\"\"q\"\"\"', s, o_orderstatus) END AS line "
    f"FROM (SELECT *, {_OWN} AS s FROM (SELECT {_DEALT} AS d, {K} AS k, o_orderstatus, o_orderpriority FROM orders)) "
    "UNION ALL SELECT d, -1, CASE WHEN d % 4 = 2 THEN '' ELSE concat('key', s, CASE WHEN d % 4 = 3 THEN concat('\"la', chr(10), 'bel\"') ELSE 'label' END, s, "
    f"CASE WHEN d % 3 = 0 THEN 'label' ELSE '' END) END FROM (SELECT DISTINCT d, {_OWN} AS s FROM (SELECT {_DEALT} AS d FROM orders))"
)


def _files(spark, sf, sql=FILES):
    """The lines of a file in key order, one file per `d`."""
    path = scratch_path(spark, "files")
    for name in ("orders", "customer"):
        load(spark, sf, name).createOrReplaceTempView(f"rowlens_{name}")
    lines = spark.sql(sql.replace("FROM orders", "FROM rowlens_orders").replace("FROM customer", "FROM rowlens_customer"))
    lines.repartition("d").sortWithinPartitions("d", "k").select("d", "line").write.partitionBy("d").text(path)
    return path


_INVENTORY = (
    f"WITH c AS (SELECT {_DEALT} AS d, {K} AS k FROM orders), w AS (SELECT d, CASE WHEN d % 4 = 2 THEN 0 ELSE 3 END AS width, {_SHAPE_OF} AS have FROM c), "
    "i AS (SELECT d, any_value(width) AS width, count(*) AS row_count, count(*) FILTER (have <> width) AS ragged_rows FROM w GROUP BY d), "
    "n AS (SELECT *, CASE WHEN width > 0 AND d % 3 <> 0 THEN 'parsing.empty_column_name:1' WHEN width > 0 AND d % 4 <> 3 THEN 'parsing.duplicate_column_name:1' END AS named, "
    "CASE WHEN width > 0 AND ragged_rows > 0 THEN concat('parsing.ragged_row:', ragged_rows) END AS torn FROM i) "
)


@register(
    "src_06",
    _INVENTORY + "SELECT CAST(width AS BIGINT) AS column_count, row_count, ragged_rows, CASE WHEN width = 0 THEN 'NO_HEADER_ROW' END AS problem, "
    "CASE WHEN ragged_rows > 1 THEN concat_ws(',', torn, named) ELSE concat_ws(',', named, torn) END AS notices FROM n",
)
def src_06(spark, sf):
    found = csv.file_inventory(csv.read_lines(spark, _files(spark, sf, MIXED)))
    told = F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["code"], x["n"].cast("string"))), ",")
    return found.select(big("column_count"), "row_count", "ragged_rows", "problem", told.alias("notices"))


_HEX = "CAST(concat('0x', substr(m, {}, {})) AS BIGINT)"


@register(
    "src_07",
    f"WITH f AS ({FILES}), c AS (SELECT d, concat(string_agg(line, chr(10) ORDER BY k), chr(10)) AS content FROM f GROUP BY d), "
    f"n AS (SELECT d, line, row_number() OVER (PARTITION BY d ORDER BY k) - 1 AS i FROM f), "
    f"leaf AS (SELECT d, i // {csv.LEAF_LINES} AS b, sha256(string_agg(sha256(line), '' ORDER BY i)) AS x FROM n GROUP BY ALL), "
    "deep AS (SELECT max(b) AS b FROM leaf), "
    "tree AS (SELECT d, CASE WHEN any_value(deep.b) = 0 THEN any_value(x) ELSE sha256(string_agg(x, '' ORDER BY leaf.b)) END AS tree_sha256 FROM leaf, deep GROUP BY d), "
    "r AS (SELECT d, md5(concat(length(line), ':', line)) AS m FROM f), "
    f"t AS (SELECT d, count(*) AS rows, bit_xor({_HEX.format(1, 15)}) AS xor_high, bit_xor({_HEX.format(16, 15)}) AS xor_low, "
    f"CAST(sum({_HEX.format(1, 8)}) AS BIGINT) AS digest_sum FROM r GROUP BY d) "
    "SELECT sha256(content) AS content_sha256, CAST(strlen(content) AS BIGINT) AS byte_size, tree_sha256, rows, xor_high, xor_low, digest_sum "
    "FROM c JOIN tree USING (d) JOIN t USING (d)",
)
def src_07(spark, sf):
    """Whole-file and tree digests of each file, and the order-free fingerprint of its rows."""
    path = _files(spark, sf)
    lines = csv.read_lines(spark, f"{path}/*")
    name = lambda c: F.regexp_extract(c, "[^/]+/[^/]+$", 0).alias("name")
    whole = csv.fingerprints(spark, f"{path}/*").select(name("path"), "content_sha256", "byte_size")
    tree = csv.tree_fingerprints(lines).select(name("file"), "tree_sha256")
    rows = csv.table_fingerprint(lines.select(name("file"), "line"), ["name"])
    return whole.join(tree, "name").join(rows, "name").select(
        "content_sha256", "byte_size", "tree_sha256", "rows", "xor_high", "xor_low", F.col("digest_sum").cast("bigint").alias("digest_sum")
    )


@register("src_08", f"SELECT {K}, row_number() OVER (ORDER BY o_custkey, {K}) - 1 AS row_number FROM orders")
def src_08(spark, sf):
    return number_rows(load(spark, sf, "orders").select("o_custkey", K), ["o_custkey", K]).select(K, "row_number")


# Workbook cells: order k sits in row k + 3 of the sheet of its customer's parity; the header is in row 2.
CELLS = (
    "SELECT concat('s', CAST(o_custkey % 2 AS STRING)) AS sheet, {k} + 3 AS row, 0 AS col, 's' AS type, CAST({k} % 200 AS STRING) AS raw FROM orders WHERE {k} % 10 <> 3 "
    "UNION ALL SELECT concat('s', CAST(o_custkey % 2 AS STRING)), {k} + 3, 1, CASE {k} % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'n' ELSE 'e' END, "
    "CASE {k} % 3 WHEN 0 THEN CAST({k} % 2 AS STRING) WHEN 1 THEN o_orderstatus ELSE '#REF!' END FROM orders WHERE {k} % 10 <> 3 AND {k} % 4 <> 1 "
    "UNION ALL SELECT concat('s', CAST(o_custkey % 2 AS STRING)), {k} + 3, 2, 'n', 'extra' FROM orders WHERE {k} % 50 = 9 "
    "UNION ALL SELECT DISTINCT concat('s', CAST(o_custkey % 2 AS STRING)), 2, 0, 'n', 'Name' FROM orders "
    "UNION ALL SELECT DISTINCT concat('s', CAST(o_custkey % 2 AS STRING)), 2, 1, 'n', 'Value' FROM orders"
).replace("{k}", K)
_DECODED = (
    f"WITH c AS ({CELLS}), dec AS (SELECT sheet, row, col, type, CASE WHEN type = 's' THEN p_name WHEN type = 'b' AND raw = '1' THEN 'TRUE' "
    "WHEN type = 'b' AND raw = '0' THEN 'FALSE' ELSE raw END AS value FROM c LEFT JOIN part ON type = 's' AND p_partkey = TRY_CAST(raw AS BIGINT)) "
)


def decoded_cells(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("rowlens_orders")
    cells = spark.sql(CELLS.replace("FROM orders", "FROM rowlens_orders"))
    strings = load(spark, sf, "part").selectExpr("p_partkey AS index", "p_name AS string")
    return grid.decode_cells(cells, strings)


SHAPE = (
    _DECODED + ", h AS (SELECT sheet, min(row) AS header_row, max(row) AS last_row FROM dec GROUP BY sheet), "
    "w AS (SELECT dec.sheet, max(col) + 1 AS width FROM dec JOIN h ON h.sheet = dec.sheet AND dec.row = header_row GROUP BY dec.sheet) "
)


@register(
    "src_09",
    SHAPE + ", r AS (SELECT unnest(range((SELECT last_row - header_row FROM h WHERE sheet = 's1'))) AS row_number) "
    "SELECT CAST(row_number AS BIGINT) AS row_number, max(value) FILTER (col = 0) AS name, max(value) FILTER (col = 1) AS value FROM r LEFT JOIN "
    "(SELECT * FROM dec WHERE sheet = 's1') d ON d.row = row_number + 3 GROUP BY row_number",
)
def src_09(spark, sf):
    table, _ = grid.sheet_rows(decoded_cells(spark, sf), "s1")
    return table.df.select("row_number", "name", "value")


@register(
    "src_10",
    _DECODED + "SELECT type = 'e' AS is_error, value, count(*) AS n, CAST(sum(row) AS BIGINT) AS row_sum FROM dec GROUP BY 1, 2",
)
def src_10(spark, sf):
    return decoded_cells(spark, sf).groupBy("is_error", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("row").cast("bigint")).alias("row_sum")
    )


@register(
    "src_11",
    SHAPE + "SELECT h.sheet, CAST(header_row AS BIGINT) AS header_row, CAST(width AS BIGINT) AS column_count, CAST(last_row - header_row AS BIGINT) AS row_count FROM h JOIN w USING (sheet)",
)
def src_11(spark, sf):
    return grid.sheet_shapes(decoded_cells(spark, sf)).select("sheet", big("header_row"), big("column_count"), big("row_count"))


WARN = (
    f"SELECT o_custkey AS dataset, CASE WHEN {K} % 31 = 0 THEN 'parsing.empty_column_name' WHEN {K} % 7 = 0 THEN 'parsing.xlsx_error_value' "
    f"WHEN {K} % 5 = 0 THEN 'parsing.field_value_truncated' WHEN {K} % 3 = 0 THEN 'parsing.duplicate_column_name' WHEN {K} % 11 = 0 THEN 'parsing.column_name_truncated' "
    f"WHEN {K} % 13 = 0 THEN 'parsing.xlsx_formula_without_cached_value' ELSE 'parsing.ragged_row' END AS code, {K} AS seen_at, o_custkey % 50 AS reference, "
    f"CAST({K} % 3 AS BIGINT) AS n FROM orders"
)


def _warnings(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("rowlens_orders")
    return spark.sql(WARN.replace("FROM orders", "FROM rowlens_orders"))


@register(
    "src_12",
    f"WITH w AS ({WARN}) SELECT code, n FROM (SELECT code, count(*) AS n, min(seen_at) AS f FROM w GROUP BY code ORDER BY n DESC, f LIMIT 6)",
)
def src_12(spark, sf):
    return csv.notices(_warnings(spark, sf))


_FOUR = "code IN ('parsing.empty_column_name', 'parsing.ragged_row', 'parsing.xlsx_formula_without_cached_value', 'parsing.xlsx_error_value')"


@register(
    "src_13",
    f"WITH w AS ({WARN}), t AS (SELECT dataset % 10 AS dataset, code, CAST(sum(n) AS BIGINT) AS total FROM w WHERE {_FOUR} GROUP BY 1, 2), "
    "r AS (SELECT dataset, code, CAST(sum(reference) AS BIGINT) AS reference_sum FROM (SELECT *, row_number() OVER (PARTITION BY dataset, code ORDER BY reference) AS k "
    f"FROM (SELECT DISTINCT dataset % 10 AS dataset, code, reference FROM w WHERE {_FOUR})) WHERE k <= 20 GROUP BY 1, 2) SELECT * FROM t JOIN r USING (dataset, code)",
)
def src_13(spark, sf):
    warnings = _warnings(spark, sf).withColumn("dataset", F.col("dataset") % 10)
    totals = csv.ingest_facts(warnings, ["dataset"]).drop("references")
    first = csv.first_references(warnings, ["dataset"]).groupBy("dataset", "code").agg(F.sum("reference").alias("reference_sum"))
    return totals.join(first, ["dataset", "code"])


@register(
    "src_14",
    _INVENTORY + ", m AS (SELECT CAST(floor(avg(row_count)) AS BIGINT) AS most FROM i), "
    "o AS (SELECT CASE WHEN width = 0 THEN 'NO_HEADER_ROW' WHEN row_count > most THEN 'ROW_LIMIT_EXCEEDED' END AS problem, row_count, CAST(width AS BIGINT) AS column_count FROM i, m) "
    "SELECT *, problem IS NULL AS can_run FROM o",
)
def src_14(spark, sf):
    """Files of more rows than the files have on average are refused."""
    lines = csv.read_lines(spark, _files(spark, sf, MIXED))
    orders = load(spark, sf, "orders")
    files = load(spark, sf, "customer").count() // 10000 + 4
    most = orders.count() // orders.select((F.col("o_custkey") % files)).distinct().count()
    found = csv.file_inventory(lines, limits=csv.Limits(max_rows=most))
    return found.select("problem", "row_count", big("column_count"), "can_run")


_PLANTED = union_sql(
    [
        f"SELECT '{kind}' AS issue_type, '{c}' AS column_name, {p} AS place"
        for kind, (places, cols) in demo.DEFECTS.items()
        for p in places
        for c in (cols or ("",))
    ]
)


_SEEN = {
    # what the planted cells look like in the table itself
    "missing_values": "quantity = ''", "missing_identifier": "sale_id = ''", "negative_measures": "quantity LIKE '-%'",
    "invalid_percentages": "discount_pct = '140' OR tax_pct = '-9'", "future_dates": "sold_on >= '2026-03-02'",
    "possible_prompt_injection": "remark <> ''", "empty_column": "spare = ''", "constant_column": "entered_by = 'till 1'",
    "whitespace": "buyer LIKE ' %' OR buyer LIKE '%\t'",
    "inconsistent_capitalization": "material = upper(material) OR material = lower(material)",
}
_PLACES = {k: (v[0] or tuple(range(demo.CYCLE))) for k, v in demo.DEFECTS.items()}


@register(
    "src_15",
    f"WITH p AS ({_PLANTED}), n AS (SELECT count(*) AS rows FROM lineitem), s AS ("
    + union_sql([f"SELECT '{k}' AS issue_type, '(table)' AS column_name, {p} AS place" for k in _SEEN for p in _PLACES[k]])
    + f"), e AS (SELECT * FROM p UNION ALL SELECT * FROM s) SELECT issue_type, column_name, "
    f"CAST(sum(greatest(rows - place + {demo.CYCLE - 1}, 0) // {demo.CYCLE}) AS BIGINT) AS planted FROM e, n GROUP BY 1, 2",
)
def src_15(spark, sf):
    """As many demo rows as lineitem has: the manifest, and the defects seen in the table."""
    numbered = number_file_rows(load(spark, sf, "lineitem")).select("row_number")
    listed = demo.manifest(numbered).groupBy("issue_type", "column_name").agg(F.count(F.lit(1)).alias("planted"))
    seen = demo.plant_defects(numbered).agg(*[F.count_if(F.expr(e)).alias(k) for k, e in _SEEN.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("issue_type"), F.lit("(table)").alias("column_name"), F.col(k).alias("planted")) for k in _SEEN])
    return listed.unionByName(seen.select(F.inline(pairs)))


# --- SNK --------------------------------------------------------------------------------------

RULES = (
    f"SELECT concat('r', CAST({K} AS STRING)) AS rule_id, concat('Rule ', o_orderpriority) AS name, 'numeric_range' AS rule_type, {K} % 7 AS minimum, {K} % 7 + 20 AS maximum, 'low' AS severity, "
    f"o_orderstatus AS column_name, 'skip' AS null_handling, {K} % 4 <> 0 AS enabled, CASE WHEN {K} % 9 = 0 THEN NULL ELSE {K} END AS pass_count, "
    f"{K} % 5 AS fail_count, {K} % 3 AS skipped_count, CASE WHEN {K} % 11 = 0 THEN 'ValueError' END AS error FROM orders"
)


@register(
    "snk_01",
    f"WITH r AS ({RULES}), ok AS (SELECT * FROM r WHERE enabled AND pass_count IS NOT NULL AND error IS NULL) "
    "SELECT rule_id, 'validation_rules' AS export_type, (SELECT count(*) FROM ok) AS rule_count, (SELECT count(*) FROM r) - (SELECT count(*) FROM ok) AS excluded_rule_count, "
    "printf('{\"rule_id\":\"%s\",\"name\":\"%s\",\"description\":\"bounds of %s\",\"rule_type\":\"numeric_range\",\"severity\":\"low\",\"columns\":[\"%s\"],\"null_handling\":\"skip\","
    "\"parameters\":{\"minimum\":%d,\"maximum\":%d},\"provenance\":\"user\",\"source_finding_ids\":[\"f%s\"],"
    "\"validation\":{\"pass_count\":%d,\"fail_count\":%d,\"skipped_count\":%d}}', rule_id, name, column_name, column_name, minimum, maximum, column_name, pass_count, fail_count, skipped_count) AS document FROM ok",
)
def snk_01(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("rowlens_orders")
    rules = spark.sql(RULES.replace("FROM orders", "FROM rowlens_orders"))
    rules = rules.select(
        "*",
        F.concat(F.lit("bounds of "), "column_name").alias("description"),
        F.struct("minimum", "maximum").alias("parameters"),
        F.lit("user").alias("provenance"),
        F.array(F.concat(F.lit("f"), "column_name")).alias("source_finding_ids"),
    )
    return rules_export(rules, "a1").select("rule_id", "export_type", "rule_count", "excluded_rule_count", "document")


def _analysis(spark, sf):
    return analyze(view_table(spark, sf, "orders_view"), analysis_id="a1", as_of=dt.date(2026, 1, 1))


_FILE = FileFacts("orders.csv", "csv", 0, "-")


@register("snk_02")
def snk_02(spark, sf):
    return report_lines(_analysis(spark, sf), _FILE)


@register("snk_03")
def snk_03(spark, sf):
    return freeze_report(report_lines(_analysis(spark, sf), _FILE), "r1")


_TEXT_COLUMNS = list(VIEWS["orders_view"][2])


@register(
    "snk_04",
    f"WITH src AS ({view_sql('orders_view')}) SELECT 'finding_rows' AS stored, 'completeness.excessive_missing_values' AS key, count(*) FILTER ({s_missing('priority')}) AS n, "
    f"CAST(sum(row_number) FILTER ({s_missing('priority')}) AS BIGINT) AS total FROM src UNION ALL SELECT 'finding_rows', 'consistency.leading_trailing_whitespace', "
    f"count(*) FILTER (priority <> {s_strip('priority')}), CAST(sum(row_number) FILTER (priority <> {s_strip('priority')}) AS BIGINT) FROM src "
    + " ".join(f"UNION ALL SELECT 'column_profile', '{c}', count(*), count(DISTINCT {c}) FILTER (NOT {s_missing(c)}) FROM src" for c in _TEXT_COLUMNS)
    + f" UNION ALL SELECT 'rules', 'written', count(*) FILTER (NOT {s_missing('priority')}), count(*) FILTER ({s_missing('priority')}) FROM src "
    "UNION ALL SELECT 'reviews', 'confirmed', CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT 'runs', 'completed', CAST(1 AS BIGINT), CAST(0 AS BIGINT) "
    "UNION ALL SELECT 'tables', 'lost rows', CAST(13 AS BIGINT), CAST(0 AS BIGINT)",
)
def snk_04(spark, sf):
    """A whole analysis with a rule and a review, stored twice over (the second adds nothing) and read back.

    `tables`: how many result tables there are, and the rows the stored ones have too few or too many.
    """
    done = _analysis(spark, sf)
    store = RunStore(spark, scratch_path(spark, "store"))
    at = dt.datetime(2026, 1, 2, tzinfo=dt.UTC)
    for _ in range(2):
        store.add(done, original_filename="orders.csv", dataset_format="csv", created_at=at)
    store.create_rule("a1", done.table, Rule("written", "not_null", ("priority",), null_handling="fail"), at=at)
    findings = store.result("findings", "a1")
    mine = findings.join(store.result("finding_columns", "a1").where("internal_key = 'priority'").select("finding_key"), "finding_key", "left_semi")
    mine = mine.where(F.col("detector_id").isin("completeness.excessive_missing_values", "consistency.leading_trailing_whitespace"))
    decided = mine.where("detector_id = 'consistency.leading_trailing_whitespace'").select(
        "finding_key", F.lit("confirmed").alias("review_state"), F.lit(None).cast("string").alias("note"),
        F.lit(None).cast("string").alias("dismissal_reason"), F.lit(at).cast("timestamp").alias("reviewed_at"),
    )
    store.add_reviews("a1", decided, "review-1")
    rows = store.result("finding_rows", "a1").join(mine.select("finding_key", "detector_id"), "finding_key")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    profile = store.result("column_profile", "a1")
    named = lambda stored, key, n, total: [F.lit(stored).alias("stored"), key.alias("key"), n.cast("bigint").alias("n"), total.cast("bigint").alias("total")]
    parts = [
        rows.groupBy("detector_id").agg(F.count(F.lit(1)).alias("n"), F.sum("row_number").alias("total")).select(
            *named("finding_rows", F.col("detector_id"), F.col("n"), F.col("total"))),
        profile.select(*named("column_profile", F.col("internal_key"), F.col("null_count") + F.col("non_null_count"), F.coalesce("distinct_count", none))),
        store.rules("a1").select(*named("rules", F.col("rule_id"), F.col("pass_count"), F.col("fail_count"))),
        store.reviewed_findings("a1").where("review_state <> 'unreviewed'").select(*named("reviews", F.col("review_state"), one, none)),
        store.runs().select(*named("runs", F.col("state"), one, none)),
    ]
    kept = None
    for name, frame in done.tables().items():
        both = frame.select(one.alias("made")).unionByName(store.result(name, "a1").select((-one).alias("made"))).agg(
            F.coalesce(F.abs(F.sum("made")), none).alias("off"))
        kept = both if kept is None else kept.unionByName(both)
    parts.append(kept.agg(F.count(F.lit(1)).alias("n"), F.sum("off").alias("total")).select(*named("tables", F.lit("lost rows"), F.col("n"), F.col("total"))))
    return reduce(lambda a, b: a.unionByName(b), parts)


__all__ = ["header_warnings"]
