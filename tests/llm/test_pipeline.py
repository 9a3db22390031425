"""Each stage of the pipeline on odd tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowlens.llm.rows import _REST

PROSE = "A plain text about the sea and the ships that cross it from one old harbour to the other in every season of year {}."


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("items"))
    spark.createDataFrame([(1, "one two three"), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def documents(spark):
    rows = [(i, PROSE.format(i), "en", "s") for i in range(6)]
    rows += [(6, PROSE.format(1), "en", "s"), (7, None, None, None), (8, "", "en", "s"), (None, PROSE.format(90) + " and more of it", "de", "s")]
    rows += [(9, "one two three " * 9 + PROSE.format(77), "en", "s"), (10, "word" * 20_000 + " " + PROSE.format(5), "en", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    for extra in ("kid", "block", "_match", "_q_counts", _REST, "text_key"):
        df = df.withColumn(extra, F.lit(extra))
    return df


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, sf_dir, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = documents(spark)
    got = stage(spark, docs, sf_dir)
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.count() == 0 and empty.columns == got.columns
    if name == "packing":
        assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
        return
    assert got.schema.simpleString() == docs.schema.simpleString()
    rows = {r.doc_id: r for r in got.collect()}
    assert all(r[c] == c for r in rows.values() for c in ("kid", "block", "_match", "_q_counts", _REST, "text_key"))
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows.values())
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - set(rows)
    # 9 repeats three words nine times; 1 to 6 differ from 0 in a word at most, 10 from 5 by a word before it
    want = {"quality_rules": {7, 8, 9}, "line_dedup": set(), "near_dedup": {1, 2, 3, 4, 5, 6, 10}, "decontamination": {9}}
    assert gone == want[name]
