"""Line dedup and secret scans against brute force, and all SQL checks of the corpus operators."""

import random
import re

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from rowlens.llm import line_dedup, queries, secret_scan
from rowlens.sources.scratch import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


def brute_lines(docs, min_lines, min_chars):
    """What stays of each (id, text): later copies by (id, line), null ids first."""
    rows = sorted({d for d in docs}, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    full = {d: [(j, s) for j, s in enumerate((d[1] or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", s)] for d in rows}
    gone = {d: set() for d in rows}
    for size in {1, min_lines}:
        seen = set()
        for d in rows:
            x = full[d]
            for i in range(len(x) - size + 1):
                run = tuple(s for _, s in x[i : i + size])
                if run in seen and (size >= min_lines or len(run[0]) >= min_chars):
                    gone[d].update(j for j, _ in x[i : i + size])
                seen.add(run)
    return {d: None if d[1] is None else "\n".join(s for j, s in enumerate(d[1].split("\n")) if j not in gone[d]) for d in rows}


@pytest.mark.parametrize(("min_lines", "min_chars"), [(1, 1), (2, 6), (3, 100), (4, 100), (7, 12)])
def test_line_dedup(spark, min_lines, min_chars):
    rnd = random.Random(min_lines)
    vocabulary = ["a", "bb", "", "ccc ccc", " ", "d" * 8, "header of every page"]
    # one document per id: order between texts of one id is by hash
    docs = [(i, "\n".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 14)))) for i in range(60)]
    docs += [(100 + i, "\n".join(f"line {i % 3} {j}" for j in range(40))) for i in range(9)]
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, "same\n" * 300), (None, "header of every page\nbb\na"), (204, "é\n😀\né\n😀")]
    df = spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string").withColumn("i", F.lit(1)).repartition(5)
    got = line_dedup.dedup(df, min_lines, min_chars).collect()
    want = brute_lines(docs, min_lines, min_chars)
    assert len(got) == len(docs) + 3
    for r in got:
        assert r._kept == want[r.doc_id, r.text], (r.doc_id, r.text)


def test_runs_are_whole(spark):
    lines = [f"line number {i} of a page" for i in range(40)]
    docs = [
        (1, "\n".join(lines[:20])), (2, "\n".join(["own", *lines[3:6], "mine"])), (3, "\n".join(["x", "", *lines[4:11], "y", *lines[0:2]])),
        (4, "\n".join(lines[30:] + lines[30:])), (None, "alone"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("kid", F.lit("k"))
    found = {r.doc_id: r for r in line_dedup.dedup(df, 3, 1000).collect()}
    runs = {k: [tuple(x) for x in r._runs or []] for k, r in found.items()}
    assert runs == {1: [], 2: [(1, 3, 1, 3)], 3: [(2, 7, 1, 4), (10, 2, 1, 0)], 4: [(10, 10, 4, 0)], None: []}
    assert found[3]._gone == list(range(2, 9)) and found[3].kid == "k" and found[4]._kept == "\n".join(lines[30:])


def test_line_dedup_of_one_long_text(spark):
    n = 200_000
    body = "\n".join(f"{i % (n // 2)}" for i in range(n))
    df = spark.createDataFrame([(1, body), (2, "1")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in line_dedup.dedup(df, 2, 40).collect()}
    assert len(found[1]._gone) == n // 2 and found[1]._kept.count("\n") == n // 2 - 1 and found[1]._runs[0].size == n // 2


def test_line_dedup_of_nothing(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "doc_id bigint, text string")
    assert sorted(r._copied_depth for r in line_dedup.dedup(df).collect()) == [0, 0]
    assert line_dedup.dedup(df.where("false")).count() == 0


def test_few_removals_do_not_deal_the_texts(spark, monkeypatch):
    line = "a line of more than forty characters, which stands in many texts"
    rows = [(i, f"own {i}\n{line}\n{line if i % 3 else 'end'}") for i in range(60)] + [(None, line), (70, None), (71, "alone")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = line_dedup.dedup(df)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
        dealt = line_dedup.dedup(df)
        assert "SortMergeJoin" in dealt._jdf.queryExecution().executedPlan().toString()
        assert sorted(few.collect(), key=str) == sorted(dealt.collect(), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_ranks_are_a_suffix_array(spark):
    text = "b\na\nb\na\nb\nc\na\nb\na\nb"
    keyed = line_dedup.with_key(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    sequence = text.split("\n")
    ids = {}
    for r in line_dedup.intervals(keyed)[0].collect():
        ids[sequence[r.i]] = r["rank"]
    for k, suffixes in enumerate(line_dedup.intervals(keyed)):
        rows = sorted(suffixes.collect(), key=lambda r: r["rank"])
        prefixes = [tuple(ids[x] for x in sequence[r.i : r.i + (1 << k)]) for r in rows]
        assert prefixes == sorted(prefixes)
        assert [p == q for p, q in zip(prefixes, prefixes[1:])] == [a["rank"] == b["rank"] for a, b in zip(rows, rows[1:])]


BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute_secrets(text):
    found = []
    for place, (kind, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), place, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


@pytest.fixture
def secrets():
    rnd = random.Random(2)
    parts = [
        "password=", "Token: ", "secret:", "api_key='", "APIKEY=", "token", "abcdef", "x", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef",
        " ", "é", "😀", "\n", "=", '"', ":", "deadbeefdeadbeefdeadbeef", "ſecret=abcdefgh", "toKen=abcdefg",
    ]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + [None, "", "f" * 40_000, "token=" * 3000]


def test_secrets(spark, secrets):
    df = spark.createDataFrame(list(enumerate(secrets)), "doc_id bigint, text string").withColumn("kind", F.lit("own"))
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "ledger"))
    secret_scan.scan(df, ledger)
    paths = df.select("doc_id", "kind", secret_scan.blob(F.col("text")).alias("_blob"))
    base = F.filter("_findings", lambda f: f["place"] < 3)
    got = {r.doc_id: r.s for r in secret_scan.by_path(paths, ledger).select("doc_id", secret_scan.written(base).alias("s")).collect()}
    assert got == {i: brute_secrets(t) for i, t in enumerate(secrets)}


def test_ledger_scans_new_pairs_only(spark):
    first = spark.createDataFrame([(1, "token=abcdef1"), (2, "nothing")], "doc_id bigint, text string")
    second = first.unionByName(spark.createDataFrame([(3, "token=zzzzzz9"), (4, "token=abcdef1")], first.schema))
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "ledger"))
    secret_scan.scan(first, ledger)
    secret_scan.scan(second, ledger)
    secret_scan.scan(second, ledger)
    assert ledger.scanned().count() == 3
    assert ledger.findings().count() == 2
    newer = (*secret_scan.BASE_RULES[1:], secret_scan.Rule("assign", 2, "zzz+"))
    secret_scan.scan(second, ledger, newer)
    again = ledger.scanned().where(F.array_contains("rules", "assign@2"))
    assert again.count() == 3 and again.where(F.size("rules") > 1).count() == 0
    paths = second.select("doc_id", secret_scan.blob(F.col("text")).alias("_blob"))
    old = {r.doc_id: len(r._findings) for r in secret_scan.by_path(paths, ledger).collect()}
    new = {r.doc_id: len(r._findings) for r in secret_scan.by_path(paths, ledger, newer).collect()}
    assert old == {1: 1, 2: 0, 3: 1, 4: 1} and new == {1: 0, 2: 0, 3: 1, 4: 0}


def test_more_rules(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9 + " xoxb-1234567890ab"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "ledger"))
    secret_scan.scan(df, ledger)
    assert {r.kind for r in ledger.findings().collect()} >= {"private_key", "github", "jwt", "slack"}
