"""CSV folders through the automatic path."""

import csv as pycsv
import random

import pytest
from pyspark.sql import functions as F

from rowlens.sources import csv


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, newline="")
    return str(folder)


def rows(table, *names):
    got = table.df.orderBy("row_number").collect()
    assert [r.row_number for r in got] == list(range(len(got)))
    return [tuple(r[n] for n in names or [c.field for c in table.columns]) for r in got]


def test_delimiters_and_column_orders(spark, tmp_path):
    path = write(tmp_path, a="id,name\n1,x\n2,y\n", b="name;id\nz;3\n", c='﻿id|name\r\n4|"a|b"\r\n')
    table = csv.read_csv(spark, path)
    assert rows(table, "id", "name") == [("1", "x"), ("2", "y"), ("3", "z"), ("4", "a|b")]


def test_other_columns_are_refused(spark, tmp_path):
    path = write(tmp_path, a="id,name\n1,x\n", b="id,other\n1,x\n")
    with pytest.raises(ValueError, match="b.csv"):
        csv.read_csv(spark, path)


def test_header_with_a_line_break(spark, tmp_path):
    path = write(tmp_path, a='id,"na\nme",x\n1,2,3\n')
    table = csv.read_csv(spark, path)
    assert [c.original_name for c in table.columns] == ["id", "na\nme", "x"]
    assert rows(table) == [("1", "2", "3")]


def test_blank_rows_beside_multi_line_fields(spark, tmp_path):
    path = write(tmp_path, a='id,v\n1,x\n\n2,"y\n\nz"\n,\n3,"a ""q"" b\n,c"\n\n')
    assert rows(csv.read_csv(spark, path)) == [
        ("1", "x"), (None, None), ("2", "y\n\nz"), ("", ""), ("3", 'a "q" b\n,c'), (None, None)]


def test_lone_quotes(spark, tmp_path):
    path = write(tmp_path, a='id,v\n1,pipe 5" wide\n2,x\n\n3,a "b" c"\n', b='id,v\n4,"two\nlines"\n5,6" and 7"\n')
    got = rows(csv.read_csv(spark, path))
    assert len(got) == 6 and got[1:3] == [("2", "x"), (None, None)] and got[4] == ("4", "two\nlines")
    assert got[0] == ("1", 'pipe 5" wide')


def test_long_fields_and_names_are_whole(spark, tmp_path):
    path = write(tmp_path, a=f"id,{'n' * 400}\n1,{'v' * 20000}\n")
    table = csv.read_csv(spark, path)
    assert len(table.columns[1].original_name) == 400 and len(rows(table)[0][1]) == 20000


def test_every_ragged_row_and_unnamed_column_is_named(spark, tmp_path):
    import datetime as dt

    from rowlens import analyze
    from rowlens.operators.detectors import structural

    body = "".join(f"{i}{',' * (29 if i % 2 else 3)}\n" for i in range(200))
    path = write(tmp_path, a="id" + "," * 29 + "\n" + body)
    done = analyze(csv.read_csv(spark, path), as_of=dt.date(2026, 1, 1), detectors=(structural.UNNAMED_COLUMN, structural.PARSE_FAILURES))
    found = {r.detector_id: (r.finding_key, r.affected_row_count) for r in done.findings.collect()}
    key, affected = found["structural.excessive_parse_failures"]
    named = {r.row_number for r in done.detection.finding_rows.where(F.col("finding_key") == key).collect()}
    assert affected == 100 and named == set(range(0, 200, 2))
    assert done.detection.finding_columns.where(F.col("finding_key") == found["structural.unnamed_column"][0]).count() == 29


def test_records_equal_the_standard_reader(spark, tmp_path):
    rnd = random.Random(4)
    cells = ["", "a", "b c", 'q "x" q', "two\nlines", "\n", '"', ",", "é;|", " lead"]
    want = []
    for n in range(3):
        data = [[rnd.choice(cells) for _ in range(4)] for _ in range(150)]
        with open(tmp_path / f"f{n}.csv", "w", newline="") as f:
            out = pycsv.writer(f, lineterminator="\n")
            out.writerow(["w", "x", "y", "z"])
            out.writerows(data)
        want += [tuple(r) for r in data]
    # small splits, so that records cross blocks
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert rows(csv.read_csv(spark, str(tmp_path))) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_inventory_has_a_byte_guard(spark, tmp_path):
    path = write(tmp_path, a="id,v\n1,2\n", b="id,v\n" + "1,2\n" * 50, c='x,"a,b"\n1,"2,3"\n4\n')
    lines = csv.read_lines(spark, path)
    found = csv.file_inventory(lines, limits=csv.Limits(max_bytes=100), sizes=csv.file_sizes(spark, path))
    got = {r.file.rsplit("/", 1)[1]: (r.problem, r.can_run, r.column_count, r.ragged_rows) for r in found.collect()}
    assert got == {"a.csv": (None, True, 2, 0), "b.csv": ("BYTE_LIMIT_EXCEEDED", False, 2, 0), "c.csv": (None, True, 2, 1)}


def test_inventory_counts_records_like_the_reader(spark, tmp_path):
    path = write(
        tmp_path,
        a='id,"na\nme",x\n1,"two\nlines",3\n4,5\n\n',
        b='id;;"a;""b";id\n1;"x;\n;y";3;4\n1;2\n7;8;9;1,0\n',
        c='\ufeffid|name\r\n1|"' + "v" * 30 + '"\r\n2|w|' + "v" * 30 + "\r\n" + "y" * 30 + '|"a"",|"\r\n',
        d="",
        e="\n1,2\n",
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")  # records cross blocks
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = csv.file_inventory(csv.read_lines(spark, path), limits=csv.Limits(max_field_length=20)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {r.file[-5:]: (r.column_count, r.row_count, r.ragged_rows, r.problem, [tuple(n) for n in r.notices]) for r in found}
    assert got == {
        "a.csv": (3, 3, 2, None, [("parsing.ragged_row", 2)]),
        "b.csv": (4, 3, 1, None, [("parsing.empty_column_name", 1), ("parsing.duplicate_column_name", 1), ("parsing.ragged_row", 1)]),
        "c.csv": (2, 3, 1, None, [("parsing.field_value_truncated", 2), ("parsing.ragged_row", 1)]),
        "e.csv": (0, 1, 1, "NO_HEADER_ROW", []),
    }
    for name in "ab":
        table = csv.read_csv(spark, f"{path}/{name}.csv")
        assert (len(table.columns), table.row_count, table.facts["ragged_row_count"]) == got[f"{name}.csv"][:3]


def test_fields_of_a_record(spark):
    cases = ["a,b", "a,", ",", '"x, ""y""",z', '"two\nlines",', 'a"b,c', '"open, to the end', '""', ""]
    df = spark.createDataFrame([(c,) for c in cases], "line string")
    got = [r[0] for r in df.select(csv.fields_of(F.col("line"), ",")).collect()]
    assert got == [["a", "b"], ["a", ""], ["", ""], ['x, "y"', "z"], ["two\nlines", ""], ['a"b', "c"], ["open, to the end"], [""], []]


def test_table_fingerprint_is_order_free_and_merges(spark):
    rows = [(i % 7, f"v{i % 11}", None if i % 5 else 1.5) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    whole = csv.table_fingerprint(df).first()
    assert csv.table_fingerprint(df.orderBy(F.rand(3)).repartition(5)).first() == whole
    assert csv.table_fingerprint(df.unionByName(df.limit(1))).first() != whole
    assert csv.table_fingerprint(df.unionByName(df.limit(1)).unionByName(df.limit(1))).first() != whole  # the ors alone would agree
    parts = csv.table_fingerprint(df.withColumn("f", F.col("a") % 3), ["f"])
    assert csv.merged(parts).first() == whole
    one, other = (csv.table_fingerprint(spark.createDataFrame([r], "a string, b string")).first() for r in (("x1", ":y"), ("x", "1:y")))
    assert one != other
    nothing = csv.table_fingerprint(df.limit(0)).first()
    assert (nothing["rows"], nothing["xor_high"], nothing["digest_sum"]) == (0, 0, 0)


def test_tree_fingerprint_in_levels(spark, tmp_path, monkeypatch):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = [f"line {i}" for i in range(50)] + ["", ""]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(reversed(lines)) + "\n")
    monkeypatch.setattr(csv, "LEAF_LINES", 4)
    monkeypatch.setattr(csv, "NODE_CHILDREN", 3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")  # several blocks a file
    try:
        got = {r.file[-5:]: (r.tree_sha256, r.lines) for r in csv.tree_fingerprints(csv.read_lines(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

    def tree(found):
        level, children = [sha(x) for x in found], 4
        while len(level) > 1 or children == 4:
            level, children = [sha("".join(level[i : i + children])) for i in range(0, len(level), children)], 3
        return level[0], len(found)

    assert got == {"a.txt": tree(lines), "b.txt": tree(lines[::-1])}


def test_joined_records_are_put_together_once(spark, tmp_path):
    path = write(tmp_path, a='id,text\n1,"x\ny"\n2,"p\n""q""\n"\n', b='id,text\n3,z\n')
    lines = csv.read_lines(spark, path).withColumn("delimiter", F.lit(","))
    found = csv.records(lines)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortMergeJoin" not in plan
    got = {(r.file[-5:], r["index"], r.line) for r in found.collect()}
    assert got == {("a.csv", 0, "id,text"), ("a.csv", 1, '1,"x\ny"'), ("a.csv", 2, '2,"p\n""q""\n"'), ("b.csv", 0, "id,text"), ("b.csv", 1, "3,z")}
