"""Documents through quality rules, line dedup, near-dedup, decontamination and packing.

Every stage reads the Parquet its predecessor wrote. The first four return the columns of
`documents`; where a text changes, `n_chars` (if there) follows it. The last returns the pieces of
the packed sequences. Further columns of any name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.llm import decontaminate, line_dedup, near_dup, packing, quality_rules
from rowlens.llm.queries import tokenizer_json
from rowlens.llm.rows import packed, unpacked
from rowlens.sources.scratch import materialize


# rows of an Arrow batch: texts have some KB each, and a batch is in memory on both sides of a worker
BATCH_ROWS = "1000"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _with_text(rows: DataFrame, like: DataFrame, text: str) -> DataFrame:
    changed = {"text": F.col(text)}
    if "n_chars" in like.columns:
        changed["n_chars"] = F.length(text)
    return unpacked(rows, like, **changed)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    _small_batches(spark)
    judged = quality_rules.judge(packed(docs, "doc_id", "text", "lang", "source"))
    return unpacked(judged.where("_q_kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are cut out; a text may end up empty, its row stays."""
    return _with_text(line_dedup.dedup(packed(docs, "doc_id", "text")), docs, "_kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    _small_batches(spark)
    return unpacked(near_dup.keep_one(packed(docs, "doc_id", "text")), docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark passages are cut out of the others."""
    _small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_text(decontaminate.clean(packed(docs, "doc_id", "text"), items), docs, "_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer_json())


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("packing", pack),
]
# tokens and pieces have no SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
