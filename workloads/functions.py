"""FN-01..20."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowlens.functions import security, text
from rowlens.functions.once import where_once
from rowlens.functions.dates import date_family
from workloads.base import *  # noqa: F403

TALLY = "count(*) AS n, CAST(sum(row_number) AS BIGINT) AS key_sum"


def _flag(name: str, view: str, column: str, expression, sql: str) -> None:
    """Register a predicate or label over one column as a tally."""

    @register(
        name,
        f"WITH src AS ({view_sql(view, [column])}) SELECT {sql.replace("@@", column)} AS label, {TALLY} "
        "FROM src GROUP BY 1",
    )
    def run(spark, sf, view=view, column=column, expression=expression):
        df = view_df(spark, sf, view, [column])
        return tally(df.withColumn("label", expression(F.col(column))), ["label"], "row_number")


_flag("fn_01", "orders_view", "priority", text.is_missing, s_missing("@@"))
_flag("fn_02", "orders_rows", "status", text.is_blank, s_blank("@@"))
_flag("fn_03", "orders_view", "mixed", text.is_boolean, s_bool("@@"))
_flag("fn_04", "orders_view", "written_day", text.is_iso_date, f"({s_day('@@')}) IS NOT NULL")
_flag("fn_05", "orders_view", "mixed", text.is_numeric, s_num("@@"))
_flag("fn_06", "orders_view", "mixed", text.value_shape, s_shape("@@"))
_flag("fn_08", "orders_view", "priority", text.near_duplicate_key, s_near("@@"))
_flag("fn_10", "orders_view", "email", text.has_email_shape, s_email("@@"))
_flag("fn_11", "orders_view", "written_day", date_family, s_date_family("@@"))
_flag("fn_12", "orders_view", "priority", text.casing_key, s_key("@@"))
_flag("fn_13", "texts", "text", security.instruction_like, s_instruction("@@"))


@register(
    "fn_07",
    f"WITH src AS ({view_sql('orders_view', ['amount'])}) SELECT {s_decorated('amount')} AS is_number, "
    "concat_ws(', ', CASE WHEN regexp_matches(amount, '[$€£¥]') THEN 'currency symbol' END, "
    "CASE WHEN suffix(amount, '%') THEN 'percent sign' END, "
    "CASE WHEN contains(amount, ',') THEN 'thousands separator' END) AS decorations, "
    f"{TALLY} FROM src GROUP BY 1, 2",
)
def fn_07(spark, sf):
    amount = F.col("amount")
    df = view_df(spark, sf, "orders_view", ["amount"]).select(
        "row_number",
        text.is_decorated_or_plain_number(amount).alias("is_number"),
        F.array_join(text.number_decorations(amount), ", ").alias("decorations"),
    )
    return tally(df, ["is_number", "decorations"], "row_number")


@register(
    "fn_09",
    "WITH names AS (SELECT o_custkey AS dataset, o_orderkey AS ordinal, "
    "CASE o_orderkey % 3 WHEN 0 THEN upper(replace(o_orderpriority, '-', '_')) "
    "WHEN 1 THEN concat(o_orderpriority, '?') ELSE o_orderpriority END AS name FROM orders) "
    "SELECT concat('k:', regexp_replace(lower(name), '[^0-9a-z]', '', 'g')) AS name_key, "
    "count(*) AS n, CAST(sum(ordinal) AS BIGINT) AS key_sum FROM names GROUP BY 1",
)
def fn_09(spark, sf):
    names = load(spark, sf, "orders").selectExpr(
        "o_orderkey AS ordinal",
        "CASE o_orderkey % 3 WHEN 0 THEN upper(replace(o_orderpriority, '-', '_')) "
        "WHEN 1 THEN concat(o_orderpriority, '?') ELSE o_orderpriority END AS name",
    )
    return tally(names.withColumn("name_key", text.name_key(F.col("name"))), ["name_key"], "ordinal")


@register(
    "fn_14",
    f"WITH src AS ({view_sql('texts', ['text'])}) SELECT row_number AS doc_id, md5({s_plain('text')}) AS plain_md5, "
    f"CAST(length({s_plain('text')}) AS BIGINT) AS plain_length FROM src",
)
def fn_14(spark, sf):
    plain = security.normalize(F.col("text"))
    return view_df(spark, sf, "texts", ["text"]).select(F.col("row_number").alias("doc_id"), plain.alias("plain")).select(
        "doc_id", F.md5("plain").alias("plain_md5"), big(F.length("plain"), "plain_length")
    )


_FAMILY_LIST = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {s_family('plain', f)} THEN '{f}' END" for f in security.FAMILIES
) + ")"
_PLAIN = f"src AS ({view_sql('texts', ['text'])}), flat AS (SELECT row_number, {s_plain('text')} AS plain FROM src)"


@register("fn_15", f"WITH {_PLAIN} SELECT {_FAMILY_LIST} AS families, {TALLY} FROM flat GROUP BY 1")
def fn_15(spark, sf):
    plain = view_df(spark, sf, "texts", ["text"]).select(
        "row_number", security.normalize(F.col("text")).alias("plain")
    )
    families = F.array_join(security.matched_families(F.col("plain")), ", ")
    return tally(plain.withColumn("families", families), ["families"], "row_number")


_SUBTYPES = (
    "concat_ws(', ', CASE WHEN "
    + " OR ".join(s_family("plain", f) for f in security.FAMILIES if f not in security.FAMILY_SUBTYPE)
    + " THEN 'prompt_injection' END, "
    + ", ".join(
        f"CASE WHEN {s_family('plain', f)} THEN '{s}' END"
        for s in security.SUBTYPES[1:]
        for f, t in security.FAMILY_SUBTYPE.items()
        if t == s
    )
    + ")"
)


@register("fn_16", f"WITH {_PLAIN} SELECT {_SUBTYPES} AS subtypes, {TALLY} FROM flat GROUP BY 1")
def fn_16(spark, sf):
    plain = view_df(spark, sf, "texts", ["text"]).select(
        "row_number", security.normalize(F.col("text")).alias("plain")
    )
    df = plain.withColumn("families", security.matched_families(F.col("plain")))
    found = F.array_join(security.subtypes(F.col("families")), ", ")
    return tally(df.withColumn("subtypes", found), ["subtypes"], "row_number")


@register("fn_17")
def fn_17(spark, sf):
    df = view_df(spark, sf, "texts", ["text"]).select(
        F.col("row_number").alias("doc_id"), security.normalize(F.col("text")).alias("plain")
    )
    flagged = df.withColumn("families", security.matched_families(F.col("plain")))
    hit = where_once(flagged, F.size("families") > 0)
    return hit.select("doc_id", security.excerpt(F.col("plain")).alias("excerpt"))


@register(
    "fn_18",
    "SELECT op, holds, count(*) AS n FROM (SELECT unnest(['equals','not_equals','less_than',"
    "'less_than_or_equal','greater_than','greater_than_or_equal']) AS op, unnest([a = b, a <> b, a < b, a <= b, a > b, a >= b]) "
    "AS holds FROM (SELECT floor(l_quantity / 10) AS a, floor(l_discount * 100 / 2) AS b FROM lineitem)) GROUP BY 1, 2",
)
def fn_18(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr(
        "CAST(floor(l_quantity / 10) AS DOUBLE) AS a", "CAST(floor(l_discount * 100 / 2) AS DOUBLE) AS b"
    )
    pairs = F.array(
        *[
            F.struct(F.lit(op).alias("op"), text.compare(F.col("a"), op, F.col("b")).alias("holds"))
            for op in text.COMPARISONS
        ]
    )
    return df.select(F.inline(pairs)).groupBy("op", "holds").agg(F.count(F.lit(1)).alias("n"))


_MD = (
    "regexp_replace(CASE WHEN length(flat) > 300 THEN concat(substr(flat, 1, 299), '…') ELSE flat END, "
    r"'([\\`*_{}\[\]<>#|!~&])', '\\\1', 'g')"
)


@register(
    "fn_19",
    f"WITH flat AS (SELECT page_id, {s_plain('html')} AS flat FROM pages) "
    f"SELECT page_id, md5({_MD}) AS escaped_md5 FROM flat",
)
def fn_19(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.md5(text.markdown(F.col("html"))).alias("escaped_md5"))


@register(
    "fn_20",
    "SELECT CAST(l_quantity AS BIGINT) AS quantity, count(*) AS n, "
    "round(sum(l_quantity * l_extendedprice * (1 - l_discount * 100 / 100) * (1 + l_tax * 100 / 100)) / 1000, 2) "
    "AS total FROM lineitem GROUP BY 1",
)
def fn_20(spark, sf):
    df = load(spark, sf, "lineitem")
    total = text.recomputed_total(
        F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount") * 100, F.col("l_tax") * 100
    )
    return df.groupBy(F.col("l_quantity").cast("bigint").alias("quantity")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(total) / 1000, 2).alias("total")
    )
