"""Secret scans over an incremental ledger of content-addressed texts.

A text is a blob named by its SHA-256, so every version of every path that holds the same text is
one blob. The ledger lists which (blob, rule version) pairs were scanned; a run scans only pairs
that are missing, appends its findings and then the pairs, and joins findings back to all paths.
A run that dies before the pairs are written is repeated by the next one; repeated findings of a
pair are read once.

A finding is (blob, rule, start, end) in code points, end exclusive. Places come from the lengths
of the pieces between matches, so everything stays in built-in functions.

Defined cases: a null text is the empty blob; paths may repeat; an empty table adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`needed`: a literal every match contains, a cheap test before the pattern. A match counts
    if group `group` has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needed: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule(
        "assign", 1,
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    # maximal runs of 24 and more are what remains of all maximal runs
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needed="PRIVATE KEY"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needed="gh"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needed="eyJ"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", needed="xox"),
)
RULES = BASE_RULES + MORE_RULES


class Ledger:
    """Two tables in a shared folder: scanned pairs and findings."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(schema).parquet(path)

    def scanned(self) -> DataFrame | None:
        return self._table("scanned", "blob string, rules array<string>")

    def findings(self) -> DataFrame:
        schema = "blob string, kind string, version int, start bigint, end bigint"
        found = self._table("findings", schema)
        return self.spark.createDataFrame([], schema) if found is None else found.distinct()

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _hits(rule: Rule) -> Column:
    """All matches of a rule; none where the pair was scanned before."""
    due = F.array_contains("_due", rule.name)
    if rule.needed:
        due = due & F.col("text").contains(rule.needed)
    none = F.array().cast("array<string>")
    return F.when(due, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).otherwise(none)


def _long_enough(rule: Rule):
    return lambda match: F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least


def find(due: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of rows (blob, text, _due: names of the rules to apply)."""
    found = due.select("blob", "text", *[_hits(r).alias(f"_h{i}") for i, r in enumerate(rules)])
    any_hit = F.lit(False)
    for i in range(len(rules)):
        any_hit = any_hit | (F.size(f"_h{i}") > 0)
    found = found.where(any_hit)
    per_rule = []
    for i, r in enumerate(rules):
        hits = F.col(f"_h{i}")
        gaps = F.transform(F.split("text", r.pattern, -1), F.length)
        counts = F.transform(hits, _long_enough(r))
        pieces = F.when(F.size(hits) > 0, F.arrays_zip(gaps.alias("gap"), F.transform(hits, F.length).alias("size"), counts.alias("counts")))
        per_rule.append(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), pieces.alias("pieces")))
    rows = (
        found.select("blob", F.inline(F.array(*per_rule)))
        .select("blob", "kind", "version", F.posexplode("pieces").alias("at", "p"))
        .select("blob", "kind", "version", "at", "p.gap", "p.size", "p.counts")
        .where(F.col("size").isNotNull())  # the piece after the last match
    )
    upto = Window.partitionBy("blob", "kind", "version").orderBy("at")
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return (
        rows.withColumn("end", end.cast("bigint")).where("counts")
        .select("blob", "kind", "version", (F.col("end") - F.col("size")).cast("bigint").alias("start"), "end")
    )


def scan(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> None:
    """Brings the ledger up to date with the texts of `versions`."""
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = versions.groupBy(blob(F.col("text")).alias("blob")).agg(
        F.first(F.coalesce(F.col("text"), F.lit(""))).alias("text")
    )
    seen = ledger.scanned()
    if seen is None:
        due = blobs.withColumn("_due", names)
    else:
        by_blob = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_seen"))
        due = (
            blobs.join(by_blob, "blob", "left")
            .withColumn("_due", F.array_except(names, F.coalesce("_seen", F.array().cast("array<string>"))))
            .where(F.size("_due") > 0)
        )
    ledger.append("findings", find(due, rules))
    if seen is None:
        pairs = versions.select(blob(F.col("text")).alias("blob")).distinct().withColumn("rules", names)
    else:
        pairs = due.select("blob", F.col("_due").alias("rules"))
    ledger.append("scanned", pairs)


def by_path(paths: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`paths` (any columns, with `_blob`) with `_findings`: array of (start, place, kind, end)."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    wanted = F.col("version") == F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])[F.col("kind")]
    found = (
        ledger.findings().where(wanted)
        .groupBy(F.col("blob").alias("_blob"))
        .agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("place"), "kind", "end"))).alias("_findings"))
    )
    return paths.join(found, "_blob", "left").withColumn("_findings", F.coalesce("_findings", F.expr("cast(array() as array<struct<start: bigint, place: int, kind: string, end: bigint>>)")))


def written(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    one = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    return F.array_join(F.transform(findings, one), ",")
