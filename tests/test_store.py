"""Stored runs, rules and reviews: only committed operations are read, a retry adds nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rowlens import analyze
from rowlens.operators import history as his
from rowlens.operators.detectors import groups, values
from rowlens.operators.rules import Rule
from rowlens.plans.store import REVIEW_SCHEMA, RunStore, rule_from, rule_text

DAY = dt.datetime(2026, 1, 2, tzinfo=dt.UTC)
NEXT = DAY + dt.timedelta(days=1)
SPELLING = "consistency.inconsistent_capitalization.city"


def analysed(text_table, name="a1"):
    table = text_table(["city", "n"], [("Rome", "1"), ("rome", "2"), ("Rome", None), (" Oslo", "4"), ("Oslo", "x")] * 4)
    return analyze(table, analysis_id=name, as_of=dt.date(2026, 1, 1), detectors=(groups.CAPITALIZATION, values.EDGE_WHITESPACE))


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, str(tmp_path / "store"))


def test_rule_text_round_trip():
    rule = Rule("r", "date_range", ("day",), minimum_date=dt.date(2020, 1, 2), accepted_values=("x", "ü"), source_finding_ids=("f",))
    assert rule_from(rule_text(rule)) == rule


def test_runs_are_read_back_once(spark, store, text_table):
    assert store.runs().count() == 0
    done = analysed(text_table)
    facts = {"original_filename": "a.csv", "dataset_format": "csv", "byte_size": 7, "content_sha256": "ff"}
    assert store.add(done, **facts, created_at=DAY) and not store.add(done, **facts, created_at=NEXT)
    # a try that broke off before its record
    done.findings.select(F.lit("a1").alias("analysis_id"), "*").write.parquet(f"{store.root}/findings/attempt=a-broken")
    assert store.add(analysed(text_table, "a2"), **facts, created_at=NEXT)
    for name, frame in done.tables().items():
        back = store.result(name, "a1").drop("analysis_id")
        assert back.columns == [c for c in frame.columns if c != "analysis_id"] and back.count() == frame.count(), name
    assert store.result("findings").count() == 2 * done.findings.count()
    newest = [r.asDict() for r in his.recent(store.runs()).collect()]
    assert [(r["analysis_id"], r["finding_count"]) for r in newest] == [(a, done.findings.count()) for a in ("a2", "a1")]
    assert {r["trust_label"] for r in newest} == {done.trust.first()["label"]}
    assert his.completed_with_content(store.runs(), "ff").count() == 2
    seen = his.seen_before(store.runs(), "00", "A.CSV").first()
    assert (seen["kind"], seen["matches"], seen["latest"]) == ("same_name", 2, "a2")


def test_rule_life_cycle(spark, store, text_table):
    done = analysed(text_table)
    mine = Rule("mine", "accepted_values", ("city",), accepted_values=("Rome",))
    with pytest.raises(ValueError, match="no completed analysis"):
        store.create_rule("a1", done.table, mine)
    store.add(done, original_filename="a.csv", dataset_format="csv", created_at=DAY)
    made = store.create_rule("a1", done.table, mine, at=DAY)
    assert made.provenance == "user_authored" and store.create_rule("a1", done.table, mine, at=NEXT) == made
    chosen = store.create_rule("a1", done.table, Rule("chosen", "accepted_values", ("city",), accepted_values=("Rome",)), source_finding=f"{SPELLING}.rome", at=DAY)
    assert (chosen.provenance, chosen.source_finding_ids) == ("ai_assisted", (f"{SPELLING}.rome",))
    refused = (
        (Rule("x", "accepted_values", ("city",), accepted_values=("Paris",)), f"{SPELLING}.rome", "candidate"),
        (Rule("x", "not_null", ("nowhere",)), None, "unknown column"),
        (Rule("x", "not_null", ("city",)), "nothing", "unknown finding"),
        (Rule("x", "no such type", ("city",)), None, "unknown rule type"),
    )
    for rule, finding, why in refused:
        with pytest.raises(ValueError, match=why):
            store.create_rule("a1", done.table, rule, source_finding=finding)
    with pytest.raises(ValueError, match="already"):
        store.create_rule("a1", done.table, mine, operation_id="other")
    with pytest.raises(ValueError, match="unknown rule"):
        store.rerun_rule("a1", done.table, "x")
    got = {r["rule_id"]: (r["pass_count"], r["fail_count"]) for r in store.rules("a1").collect()}
    assert got == {"mine": (8, 12), "chosen": (8, 12)}
    mended = text_table(["city", "n"], [("Rome", "1")] * 9 + [("oslo", "1")])
    assert store.rerun_rule("a1", mended, "mine", operation_id="second", at=NEXT)
    assert not store.rerun_rule("a1", mended, "mine", operation_id="second", at=NEXT)
    got = {r["rule_id"]: (r["pass_count"], r["fail_count"], r["executed_at"].day) for r in store.rules("a1").collect()}
    assert got == {"mine": (9, 1, 3), "chosen": (8, 12, 2)}
    assert store.rule_results("a1").count() == 3
    assert [r["row_number"] for r in store.latest_failures("a1").where("rule_id = 'mine'").collect()] == [9]


def test_reviews(spark, store, text_table):
    done = analysed(text_table)
    store.add(done, original_filename="a.csv", dataset_format="csv")
    key = f"{SPELLING}.rome"
    for i, state in enumerate(("confirmed", "needs_investigation")):
        decided = spark.createDataFrame([(key, state, None, None, DAY + i * dt.timedelta(hours=1))], REVIEW_SCHEMA)
        assert store.add_reviews("a1", decided, f"review-{i}")
    assert not store.add_reviews("a1", decided, "review-1")
    states = {r["finding_key"]: r["review_state"] for r in store.reviewed_findings("a1").collect()}
    assert states.pop(key) == "needs_investigation" and set(states.values()) == {"unreviewed"}
