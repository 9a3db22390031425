"""The thirteen operators bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.llm import (
    decontaminate,
    importance,
    line_dedup,
    lm_score,
    near_dup,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    spelling,
    substring_dedup,
    toxicity,
    url_filter,
)
from rowlens.sources.scratch import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def _op1_sql(levels: int = 14) -> str:
    ranks = ["r0 AS (SELECT *, dense_rank() OVER (ORDER BY body) AS r FROM numbered)"]
    for k in range(1, levels):
        ranks.append(
            f"n{k} AS (SELECT * EXCLUDE (r), r AS a, lead(r, {1 << (k - 1)}) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM r{k - 1}), "
            f"r{k} AS (SELECT * EXCLUDE (a, b), dense_rank() OVER (ORDER BY a, b) AS r FROM n{k} WHERE b IS NOT NULL)"
        )
    later = " UNION ALL ".join(
        f"SELECT doc_id, i, p, chars, {1 << k} AS depth, min(p) OVER (PARTITION BY r) AS f FROM r{k}" for k in range(levels)
    )
    # the walk: from the earliest suffix of the deepest interval, a round at a time
    steps = [
        f"w{levels - 1} AS (SELECT doc_id, i, p, max(depth) AS top, arg_max(f, depth) AS f, max(depth) AS size FROM found GROUP BY doc_id, i, p), "
        f"z{levels - 1} AS (SELECT w.*, n.doc_id AS fd, n.i AS fi FROM w{levels - 1} w JOIN numbered n ON n.p = w.f)"
    ]
    for k in range(levels - 2, -1, -1):
        steps.append(
            f"z{k} AS (SELECT z.* EXCLUDE (size), z.size + CASE WHEN a.r = b.r AND z.top > {1 << k} THEN {1 << k} ELSE 0 END AS size FROM z{k + 1} z "
            f"LEFT JOIN r{k} a ON a.doc_id = z.doc_id AND a.i = z.i + z.size LEFT JOIN r{k} b ON b.doc_id = z.fd AND b.i = z.fi + z.size)"
        )
    walk = ", ".join(steps) + ", longest AS (SELECT doc_id, max(size) AS s FROM z0 GROUP BY doc_id),"
    return f"""
WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
numbered AS (SELECT doc_id, body, line, length(body) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i,
  row_number() OVER (ORDER BY doc_id, line) AS p FROM cut WHERE regexp_matches(body, '[^\\x20\\x09-\\x0D]')),
{", ".join(ranks)},
found AS (SELECT * FROM ({later}) WHERE f < p),
gone AS (
  SELECT doc_id, i FROM found WHERE depth = 1 AND chars >= {line_dedup.MIN_CHARS}
  UNION SELECT doc_id, i + s AS i FROM found, range({line_dedup.MIN_LINES}) AS t(s) WHERE depth = {line_dedup.MIN_LINES}),
depths AS (SELECT doc_id, max(depth) AS d FROM found GROUP BY doc_id),
{walk}
kept AS (
  SELECT cut.doc_id, count(n.i) AS n_lines, count(g.i) AS n_removed,
    coalesce(string_agg(cut.body, chr(10) ORDER BY cut.line) FILTER (g.i IS NULL), '') AS body
  FROM cut LEFT JOIN numbered n ON n.doc_id = cut.doc_id AND n.line = cut.line
  LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY cut.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(depths.d, 0) AS BIGINT) AS copied_depth, CAST(coalesce(longest.s, 0) AS BIGINT) AS longest_run,
  sha256(coalesce(kept.body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN depths USING (doc_id) LEFT JOIN longest USING (doc_id)"""


@register("op1_line_dedup", _op1_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    full = F.filter(line_dedup.split_lines(F.col("text")), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return found.select(
        "doc_id",
        F.coalesce(F.size(full), F.lit(0)).cast("bigint").alias("n_lines"),
        F.size(F.coalesce("_gone", F.array().cast("array<int>"))).cast("bigint").alias("n_removed"),
        F.col("_copied_depth").alias("copied_depth"),
        F.coalesce(F.array_max(F.transform("_runs", lambda r: r["size"])), F.lit(0)).cast("bigint").alias("longest_run"),
        F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"),
    )


def _op2_sql() -> str:
    def text(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    parts = []
    for i, r in enumerate(secret_scan.RULES):
        p = text(r.pattern)
        parts.append(
            f"SELECT k, '{r.kind}' AS kind, {i} AS place, unnest(regexp_extract_all(body, {p})) AS hit, "
            f"unnest(string_split_regex(body, {p})) AS gap, generate_subscripts(string_split_regex(body, {p}), 1) AS nth, "
            f"{p} AS pattern, {r.group} AS grp, {r.least} AS least FROM src WHERE regexp_matches(body, {p})"
        )
    cases = " ".join(
        f"WHEN place = {i} THEN length(regexp_extract(hit, {text(r.pattern)}, {r.group})) >= {r.least}"
        for i, r in enumerate(secret_scan.RULES)
    )
    base = len(secret_scan.BASE_RULES)
    one = "kind || ':' || (upto - length(hit)) || ':' || upto"
    return f"""
WITH src AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body FROM documents),
cut AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY k, place ORDER BY nth) AS upto FROM cut WHERE hit IS NOT NULL),
good AS (SELECT * FROM placed WHERE CASE {cases} END),
per AS (SELECT k, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
  string_agg({one}, ',' ORDER BY upto - length(hit), place) FILTER (place < {base}) AS base,
  string_agg({one}, ',' ORDER BY upto - length(hit), place) AS every FROM good GROUP BY k)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM src LEFT JOIN per USING (k)"""


@register("op2_secret_scan", _op2_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "secret-ledger"))
    secret_scan.scan(docs, ledger)
    found = secret_scan.by_path(docs.select("doc_id", secret_scan.blob(F.col("text")).alias("_blob")), ledger)
    of = lambda kind: F.size(F.filter("_findings", lambda f: f["kind"] == kind)).cast("bigint")
    base = F.filter("_findings", lambda f: f["place"] < len(secret_scan.BASE_RULES))
    return found.select(
        "doc_id",
        *[of(r.kind).alias(f"n_{r.kind}") for r in secret_scan.BASE_RULES],
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(F.col("_findings")).alias("spans"),
    )


@register("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.match(docs, load(spark, sf_dir, "benchmark"))
    n_words, n_hit = F.col("n_words"), F.col("n_hit")
    return (
        found.select(
            "doc_id",
            F.col("_match.n_words").alias("n_words"),
            decontaminate.hit_words(F.col("_match.runs")).alias("n_hit"),
            F.size("_match.items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join(F.array_sort("_match.items"), ","), 256).alias("items_sha256"),
        ).withColumn("contaminated", decontaminate.contaminated(n_words, n_hit))
    )


URL_RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]
# pages littered with runs of signs, in whatever language, list their address
LITTER, LITTERED = "[*$%#]{3}", 10

_URL = r"'(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?'"
_HOST = f"translate(coalesce(regexp_extract(url, {_URL}, 1), ''), '{url_filter._UPPER}', '{url_filter._LOWER}')"
_FITS = {
    f"{h}{p}": f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in URL_RULES
}
_LONGEST = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
OP4_SQL = f"""
WITH parts AS (
  SELECT page_id, html, {_HOST} AS host, coalesce(regexp_extract(url, {_URL}, 2), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, {_URL}, 3), ''), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '{url_filter.TRACKING}'))) AS args
  FROM pages),
keyed AS (
  SELECT page_id, html, host, path, CASE WHEN regexp_replace(host, '^www[.]', '') <> '' THEN
    regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canon FROM parts),
listed AS (SELECT DISTINCT canon FROM keyed WHERE canon IS NOT NULL AND len(regexp_extract_all(html, '{LITTER}')) >= {LITTERED}),
ruled AS (
  SELECT page_id, host, path, canon,
    CASE {" ".join(f"WHEN {_FITS[h + p]} THEN '{h}{p}'" for _, h, p in _LONGEST)} END AS rule,
    CASE {" ".join(f"WHEN {_FITS[h + p]} THEN '{v}'" for v, h, p in _LONGEST)} END AS decided FROM keyed)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN listed ON ruled.canon = listed.canon
"""


@register("op4_url_filter", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    listed = materialize(pages.where(F.regexp_count("html", F.lit(LITTER)) >= LITTERED).select("url"), "listed-urls")
    judged = url_filter.judge(pages.select("page_id", "url"), listed, URL_RULES)
    return judged.select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"),
    )


def tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    from pathlib import Path

    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


@register("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_json())


@register("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    known = materialize(
        quality_classifier.with_features(docs)
        .select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "_x"),
        "classifier-features",
    )
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    taught = known.where(~F.col("held_out")).join(labels, "doc_id")
    model = quality_classifier.fit(taught, "_x", "quality")
    return known.select(
        "doc_id", "held_out", quality_classifier.scored(F.col("_x"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality_rules.judge(docs)
    return judged.select(
        "doc_id",
        *[F.col(f"_q_counts.{c}").alias(c) for c in quality_rules.BASE],
        F.col("_q_base_failed").alias("base_failed"),
        F.col("_q_kept").alias("kept"),
    )


@register("op8_minhash_near_dup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.groups(load(spark, sf_dir, "documents").select("doc_id", "text"), size=2, percent=80)
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@register("op9_lm_score")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score(docs, public_tokenizers.path("piece_bpe_32k.model"), remainder("doc_id", 5) == 1)


@register("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(load(spark, sf_dir, "documents").select("doc_id", "text"), window=35)


@register("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = docs.withColumn("held_out", remainder("doc_id", 5) == 0)
    found = toxicity.scored(docs, labels, "doc_id", "toxic", ~F.col("held_out"))
    score = F.col("_toxic_score").alias("score")
    return found.select("doc_id", "held_out", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register("op13_importance_resampling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.importance(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
