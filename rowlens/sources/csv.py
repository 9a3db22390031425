"""CSV ingest (SRC-01, 02, 04..07, 12..14).

Files are read as lines, so a file splits over many tasks and blank lines stay visible. A line is
a function from "starts inside quotes or not" to "ends inside quotes or not"; composing these
functions, first within blocks and then over the few blocks, tells which lines continue the record
before them, and only files with such lines are put together. Every file keeps its own delimiter
and header; columns are aligned by normalized name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlens.operators.table import ColumnRef, Table, name_columns
from rowlens.sources.headers import header_warnings, normalize_headers
from rowlens.sources.rownum import ROW_NUMBER, broadcast_if_small
from rowlens.sources.scratch import materialize

# Delimiter candidates in tie order.
DELIMITERS = (",", ";", "\t", "|")
MAX_REFERENCES = 20
MAX_NOTICES = 6
# The warnings of one header cell in the order they are given.
_HEADER_CODES = ("parsing.empty_column_name", "parsing.column_name_truncated", "parsing.duplicate_column_name")
# distinct headers of one folder; more are a sign that the files are not one table
MAX_HEADERS = 1000


@dataclass(frozen=True)
class Limits:
    """Optional guards; a file beyond one is refused, never sampled."""

    max_bytes: int | None = None
    max_rows: int | None = None
    max_columns: int | None = None
    max_field_length: int | None = None
    max_name_length: int | None = None


def pick_delimiter(line: Column) -> Column:
    """SRC-02: the most frequent candidate in the first line; earlier wins ties; default comma."""
    head = line
    counts = [F.length(head) - F.length(F.replace(head, F.lit(d), F.lit(""))) for d in DELIMITERS]
    best = F.greatest(*counts)
    choice = F.lit(DELIMITERS[0])
    for d, c in reversed(list(zip(DELIMITERS, counts, strict=True))):
        choice = F.when((best > 0) & (c == best), d).otherwise(choice)
    return choice


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file and place; blank lines included."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mono"),
        F.col("value").alias("line"),
    )


def _without_return(line: Column) -> Column:
    return F.regexp_replace(line, "\\r$", "")


def first_lines(lines: DataFrame) -> DataFrame:
    """The header line of every file, byte-order mark removed."""
    return (
        lines.where(F.col("block") == 0)
        .groupBy("file")
        .agg(F.min_by("line", "mono").alias("line"))
        .select("file", _without_mark(_without_return(F.col("line"))).alias("line"))
    )


def file_delimiters(lines: DataFrame) -> DataFrame:
    return first_lines(lines).select("file", pick_delimiter(F.col("line")).alias("delimiter"))


def _quoted(delimiter: str) -> str:
    return "\\" + delimiter if delimiter == "|" else delimiter


_REST = r'[^"]*+(?:""[^"]*+)*+'  # of a quoted field, up to its closing quote


def leaves_quote_open(line: Column, delimiter: str) -> Column:
    """Does a line that starts outside quotes end inside a quoted field?

    Only a quote at the start of a field opens one. Possessive throughout, so linear.
    """
    d = _quoted(delimiter)
    field = rf'(?:"{_REST}"[^{d}]*+|(?!")[^{d}]*+){d}'
    return line.contains('"') & line.rlike(rf'(?s)^(?:{field})*+"{_REST}\z')


def field_counts(line: Column, delimiter: str) -> Column:
    """Fields of a record: delimiters outside quoted fields, plus one; none in a blank line."""
    d = _quoted(delimiter)
    bare = F.regexp_replace(line, rf'(?s)(^|{d})"{_REST}(?:"|\z)', "$1")
    return F.when(line == "", 0).otherwise(
        F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
    )


def _by_delimiter(make) -> Column:
    """`make(delimiter)` for the row's own delimiter."""
    out = make(DELIMITERS[0])
    for d in DELIMITERS[1:]:
        out = F.when(F.col("delimiter") == d, make(d)).otherwise(out)
    return out


def _without_mark(line: Column) -> Column:
    return F.regexp_replace(line, "^\ufeff", "")


def parse_header(spark: SparkSession, line: str, delimiter: str) -> list[str]:
    """One header record as names: parsed by the same CSV parser as the rows."""
    row = spark.createDataFrame([(line,)], "line string")
    width = row.select(field_counts(F.col("line"), delimiter).alias("n")).first()["n"]
    schema = ", ".join(f"c{i} string" for i in range(max(width, 1)))
    parsed = row.select(F.from_csv("line", schema, _options(delimiter)).alias("h")).first()["h"]
    return [v or "" for v in parsed]


# --- lines to records ---------------------------------------------------------------------------


def _composed(over, state: str, other: str) -> tuple[Column, Column]:
    """State after the rows of an ordered window, for a start outside and inside quotes.

    A row maps outside to `state` and inside to `other`; equal values forget the start, the pair
    (true, false) turns it round, and (false, true) keeps it.
    """
    turns = F.sum((F.col(state) & ~F.col(other)).cast("int")).over(over)
    fixed = F.col(state) == F.col(other)
    value = F.last(F.when(fixed, F.col(state)), ignorenulls=True).over(over)
    return value, turns


def records(lines: DataFrame) -> DataFrame:
    """(file, block, mono, line, delimiter) -> the same with whole records, and `index`: the
    record's number within its (file, block)."""
    marked = materialize(
        lines.withColumn("opens", _by_delimiter(lambda d: leaves_quote_open(F.col("line"), d))), "csv-lines"
    )
    first = broadcast_if_small(marked.groupBy("file", "block").agg(F.min("mono").alias("_first")))

    def indexed(plain: DataFrame) -> DataFrame:
        """Lines that are records: ids of one block are consecutive, as one task reads it front to back."""
        numbered = plain.join(first, ["file", "block"]).withColumn("index", F.col("mono") - F.col("_first"))
        return numbered.select("file", "block", "mono", "line", "delimiter", "index")

    joined = materialize(marked.where("opens").select("file").distinct(), "csv-joined-files")
    if joined.isEmpty():
        return indexed(marked)
    joined = broadcast_if_small(joined)
    plain = indexed(marked.join(joined, "file", "left_anti"))
    # counts, headers and rows are read from them: put together once, as every line is shuffled for it
    whole = materialize(_joined_records(marked.join(joined, "file", "left_semi")), "csv-whole-records")
    return plain.unionByName(whole)


def _joined_records(marked: DataFrame) -> DataFrame:
    within = W.partitionBy("file", "block").orderBy("mono").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = F.when(
        F.col("line").contains('"'), _by_delimiter(lambda d: leaves_quote_open(F.concat(F.lit('"'), F.col("line")), d))
    ).otherwise(True)
    narrow = marked.select("file", "block", "mono", "opens", inside.alias("stays"))
    value, turns = _composed(within, "opens", "stays")
    placed = narrow.withColumn("value", value).withColumn("turns", turns)
    at_value = F.last(F.when(F.col("opens") == F.col("stays"), F.col("turns")), ignorenulls=True).over(within)
    placed = materialize(
        placed.withColumn("turns", F.col("turns") - F.coalesce(at_value, F.lit(0))).select("file", "block", "mono", "value", "turns"),
        "csv-states",
    )
    turned = lambda v, t: F.when(t % 2 == 1, ~v).otherwise(v)
    # one row per block: what it does to a start outside and inside quotes
    last = placed.groupBy("file", "block").agg(F.max_by(F.struct("value", "turns"), "mono").alias("s"))
    effect = last.select(
        "file", "block",
        turned(F.coalesce("s.value", F.lit(False)), F.col("s.turns")).alias("opens"),
        turned(F.coalesce("s.value", F.lit(True)), F.col("s.turns")).alias("stays"),
    )
    over = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    value, turns = _composed(over, "opens", "stays")
    chained = effect.withColumn("value", value).withColumn("turns", turns)
    at_value = F.last(F.when(F.col("opens") == F.col("stays"), F.col("turns")), ignorenulls=True).over(over)
    after = turned(F.coalesce("value", F.lit(False)), F.col("turns") - F.coalesce(at_value, F.lit(0)))
    starts = chained.withColumn("after", after).select(
        "file", "block", F.coalesce(F.lag("after").over(W.partitionBy("file").orderBy("block")), F.lit(False)).alias("start")
    )
    ordered = W.partitionBy("file", "block").orderBy("mono")
    ended = placed.join(broadcast_if_small(starts), ["file", "block"]).withColumn(
        "after", turned(F.coalesce("value", F.col("start")), F.col("turns"))
    )
    told = ended.withColumn("continues", F.coalesce(F.lag("after").over(ordered), F.col("start")))
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    told = told.select(
        "file", "block", "mono", "continues",
        F.last(F.when(~F.col("continues"), F.col("mono")), ignorenulls=True).over(upto).alias("own"),
        (F.sum((~F.col("continues")).cast("bigint")).over(upto) - 1).alias("index"),
    )
    told = materialize(told, "csv-records")
    # a block may begin inside a record that began blocks before
    begun = told.groupBy("file", "block").agg(F.max("own").alias("own"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("own").isNotNull(), F.struct("block", "own")), ignorenulls=True).over(before)
    begun = begun.select("file", "block", carried.alias("carried"))
    lines = (
        marked.join(told, ["file", "block", "mono"])
        .join(broadcast_if_small(begun), ["file", "block"])
        .withColumn("home", F.when(F.col("own").isNotNull(), F.struct("block", "own")).otherwise(F.col("carried")))
    )
    whole = lines.groupBy("file", "home").agg(
        F.array_sort(F.collect_list(F.struct("block", "mono", "line"))).alias("parts"),
        F.first("delimiter").alias("delimiter"),
        F.min(F.when(~F.col("continues"), F.col("index"))).alias("index"),
    )
    return whole.select(
        "file", F.col("home.block").alias("block"), F.col("home.own").alias("mono"),
        F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line"), "delimiter", "index",
    )


def number_records(found: DataFrame) -> DataFrame:
    """Adds `in_file` (0 is the header) and `row_number` over all data records in path order."""
    counts = found.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    every = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "file", "block",
        F.coalesce(F.sum("_n").over(every), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_before_in_file"),
        F.dense_rank().over(W.orderBy("file")).alias("_files"),
    )
    return (
        found.join(broadcast_if_small(offsets), ["file", "block"])
        .withColumn("in_file", F.col("_before_in_file") + F.col("index"))
        # as many headers come before a record as there are files up to its own
        .withColumn(ROW_NUMBER, (F.col("_before") + F.col("index") - F.col("_files")).cast("long"))
        .drop("_before", "_before_in_file", "_files", "index")
    )


def _options(delimiter: str) -> dict[str, str]:
    return {
        "sep": delimiter,
        "quote": '"',
        "escape": '"',
        "mode": "PERMISSIVE",
        "maxColumns": "100000",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "columnNameOfCorruptRecord": "_bad",
    }


def repair_rows(
    parsed: DataFrame, fields: list[str], delimiter: str, max_field_length: int | None
) -> DataFrame:
    """SRC-04/05 on `parsed(row_number, line, rec)`.

    An empty cell of a complete row is the empty string; a cell a short row never had is null;
    extra cells are dropped. With a limit, values beyond it are cut and marked.
    """
    width = len(fields)
    bad = F.col("rec._bad").isNotNull() | (F.col("line") == "")
    have = F.when(bad, field_counts(F.col("line"), delimiter)).otherwise(width)
    cut = max_field_length
    cells = []
    long_cell = F.lit(False)
    for i, name in enumerate(fields):
        value = F.when(F.col("_have") > i, F.coalesce(F.col(f"rec.c{i}"), F.lit("")))
        if cut:
            long_cell = long_cell | F.coalesce(F.length(value) > cut, F.lit(False))
            value = F.substring(value, 1, cut)
        cells.append(value.alias(name))
    return parsed.withColumn("_have", have).select(
        ROW_NUMBER, *cells, (F.col("_have") != width).alias("_ragged"), long_cell.alias("_cut")
    )


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    delimiter: str | None = None,
    limits: Limits = Limits(),
) -> Table:
    """SRC-01: a folder of CSV files with the same columns, as an all-text table.

    Every file has its own delimiter (unless one is given) and column order; a file whose columns
    are not those of the first is refused by name. The parsed rows are written once as Parquet,
    which also fixes the row order (SRC-08).
    """
    if limits.max_bytes is not None:
        size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
        if size > limits.max_bytes:
            raise ValueError(f"{size} bytes are more than the limit of {limits.max_bytes}")
    lines = read_lines(spark, path)
    if delimiter is None:
        lines = lines.join(broadcast_if_small(file_delimiters(lines)), "file")
    else:
        lines = lines.withColumn("delimiter", F.lit(delimiter))
    numbered = number_records(records(lines)).withColumn("line", _without_return(F.col("line")))
    heads = materialize(
        numbered.where("in_file = 0").select("file", "delimiter", _without_mark(F.col("line")).alias("header")), "csv-headers"
    )
    shapes = heads.groupBy("delimiter", "header").agg(F.min("file").alias("first_file")).orderBy("first_file").limit(MAX_HEADERS + 1).collect()
    if len(shapes) > MAX_HEADERS:
        raise ValueError(f"the files have more than {MAX_HEADERS} different headers")
    if not shapes or any(h["header"] == "" for h in shapes):
        raise ValueError("there is no header row with at least one column")
    layouts = []
    for h in shapes:
        names = parse_header(spark, h["header"], h["delimiter"])
        if limits.max_columns is not None and len(names) > limits.max_columns:
            raise ValueError(f"{len(names)} columns are more than the limit of {limits.max_columns}")
        layouts.append((h, name_columns(names, limits.max_name_length)))
    described = layouts[0][1]
    fields = [key for _, key, _ in described]
    for h, own in layouts:
        if sorted(key for _, key, _ in own) != sorted(fields):
            raise ValueError(f"the columns of {h['first_file']} are not those of {shapes[0]['first_file']}")
    rows = numbered.where("in_file > 0")
    parts = []
    for h, own in layouts:
        mine = rows
        if len(layouts) > 1:
            files = heads.where((F.col("delimiter") == h["delimiter"]) & (F.col("header") == h["header"])).select("file")
            mine = rows.join(broadcast_if_small(files), "file", "left_semi")
        schema = ", ".join(f"c{i} string" for i in range(len(own))) + ", _bad string"
        parsed = mine.withColumn("rec", F.from_csv("line", schema, _options(h["delimiter"])))
        keys = [key for _, key, _ in own]
        parts.append(repair_rows(parsed, keys, h["delimiter"], limits.max_field_length).select(ROW_NUMBER, *fields, "_ragged", "_cut"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    stored = materialize(whole, "rows")
    facts = ingest_counts(stored, described)
    if limits.max_rows is not None and facts["row_count"] > limits.max_rows:
        raise ValueError(f"{facts['row_count']} rows are more than the limit of {limits.max_rows}")
    columns = [
        ColumnRef(i, name, key, key, "text") for i, (name, key, _) in enumerate(described)
    ]
    return Table(stored.drop("_ragged", "_cut"), columns, facts)


def ingest_counts(stored: DataFrame, described: list[tuple[str, str, list[str]]]) -> dict:
    """SRC-13 for one CSV table: exact totals, every ragged row (a frame) and unnamed column."""
    counts = stored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("_ragged").alias("ragged"),
        F.count_if("_cut").alias("cut"),
    ).first()
    unnamed = [i for i, (_, _, codes) in enumerate(described) if "parsing.empty_column_name" in codes]
    warnings: dict[str, int] = {}
    for _, _, codes in described:
        for code in codes:
            warnings[code] = warnings.get(code, 0) + 1
    if counts["ragged"]:
        warnings["parsing.ragged_row"] = counts["ragged"]
    if counts["cut"]:
        warnings["parsing.field_value_truncated"] = counts["cut"]
    return {
        "row_count": counts["rows"],
        "column_count": len(described),
        "unnamed_column_count": len(unnamed),
        "unnamed_columns": unnamed,
        "ragged_row_count": counts["ragged"],
        "ragged_rows": stored.where("_ragged").select(ROW_NUMBER),
        "formula_without_cached_value_cell_count": 0,
        "error_value_cell_count": 0,
        "warnings": warnings,
    }


# --- folder-wide inventory -------------------------------------------------------------------


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, byte_size) without reading any content."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("byte_size"))


def fields_of(record: Column, delimiter: str) -> Column:
    """The fields of a record as text: quotes around a field removed, doubled ones inside it undone."""
    d = _quoted(delimiter)
    # the pattern also finds the empty end of a record, so fields are counted apart
    found = F.regexp_extract_all(record, F.lit(rf'(?s)("{_REST}(?:"[^{d}]*+|\z)|[^{d}]*+)(?:{d}|\z)'), F.lit(1))
    cells = F.slice(found, F.lit(1), field_counts(record, delimiter))
    quoted = lambda x: F.replace(F.regexp_replace(x, r'^"|"\z', ""), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda x: F.when(x.startswith('"'), quoted(x)).otherwise(x))


def file_inventory(
    lines: DataFrame, delimiter: str | None = None, limits: Limits = Limits(), sizes: DataFrame | None = None
) -> DataFrame:
    """SRC-06/14: per file its shape, ragged rows, notices and refusals, as `read_csv` would read it.

    Works on records, so a line break inside a field ends no row, and every file has its own
    delimiter unless one is given. The records of a file are reduced to counts per number of fields;
    the header is the record at the first place. `notices` are the most common warnings (code, n),
    ties in the order seen. With `sizes(file, byte_size)` the byte guard is applied too.
    """
    if delimiter is None:
        lines = lines.join(broadcast_if_small(file_delimiters(lines)), "file")
    else:
        lines = lines.withColumn("delimiter", F.lit(delimiter))
    found = records(lines).withColumn("line", _without_return(F.col("line")))
    place = F.struct("block", "mono")
    # only a file's first block can hold its header
    heads = found.where("block = 0").groupBy("file").agg(
        F.min(place).alias("head"), F.min_by(F.struct("line", "delimiter"), place).alias("first")
    )
    heads = materialize(
        heads.select("file", "head", _without_mark(F.col("first.line")).alias("line"), F.col("first.delimiter").alias("delimiter")),
        "inventory-headers",
    )
    too_far = F.lit(None).cast("int")
    if limits.max_field_length is not None:
        long = lambda d: F.array_position(
            F.transform(fields_of(F.col("line"), d), lambda x: F.length(x) > limits.max_field_length), True
        )
        too_far = F.nullif(_by_delimiter(long).cast("int"), F.lit(0))
    have = _by_delimiter(lambda d: field_counts(F.col("line"), d))
    counted = found.select("file", "block", "mono", have.alias("have"), too_far.alias("long_at"))
    widths = heads.select("file", "head", have.alias("column_count"))
    rows = counted.groupBy("file", "have", "long_at").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("seen"))
    rows = rows.join(broadcast_if_small(widths), "file").withColumn("n", F.col("n") - (F.col("seen") == F.col("head")).cast("int"))
    ragged, cut = F.col("have") != F.col("column_count"), F.col("long_at") <= F.least("have", "column_count")
    shapes = rows.groupBy("file").agg(
        F.first("column_count").alias("column_count"),
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(ragged, F.col("n"))), F.lit(0)).alias("ragged_rows"),
        F.coalesce(F.sum(F.when(cut, F.col("n"))), F.lit(0)).alias("cut_rows"),
        F.min(F.when(ragged & (F.col("n") > 0), F.col("seen"))).alias("ragged_seen"),
        F.min(F.when(cut & (F.col("n") > 0), F.col("seen"))).alias("cut_seen"),
    )
    names = heads.select("file", F.posexplode(_by_delimiter(lambda d: fields_of(F.col("line"), d))).alias("ordinal", "name"))
    order = F.array_position(F.array(*map(F.lit, _HEADER_CODES)), F.col("code"))
    in_header = header_warnings(normalize_headers(names, limits.max_name_length)).groupBy("file", "code").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("ordinal").cast("bigint").alias("a"), order.alias("b"))).alias("at")
    )
    in_header = in_header.select("file", "code", "n", F.lit(0).alias("part"), F.col("at.a").alias("a"), F.col("at.b").alias("b"), F.lit(0).alias("c"))
    kinds = F.array(*[
        F.struct(F.lit(code).alias("code"), F.col(n).alias("n"), F.col(f"{seen}.block").alias("a"), F.col(f"{seen}.mono").alias("b"), F.lit(i).alias("c"))
        for i, (code, n, seen) in enumerate((("parsing.ragged_row", "ragged_rows", "ragged_seen"), ("parsing.field_value_truncated", "cut_rows", "cut_seen")))
    ])
    in_rows = shapes.select("file", F.inline(kinds)).where("n > 0").select("file", "code", "n", F.lit(1).alias("part"), "a", "b", "c")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "part", "a", "b", "c", "code", "n")))
    told = in_header.unionByName(in_rows).groupBy("file").agg(
        F.transform(F.slice(ranked, 1, MAX_NOTICES), lambda x: F.struct(x["code"].alias("code"), x["n"].alias("n"))).alias("notices")
    )
    shapes = shapes.join(told, "file", "left")
    shapes = (
        shapes.withColumn("byte_size", F.lit(None).cast("bigint"))
        if sizes is None
        else shapes.join(broadcast_if_small(sizes), "file", "left")
    )
    too_wide = F.lit(False) if limits.max_columns is None else F.col("column_count") > limits.max_columns
    too_long = F.lit(False) if limits.max_rows is None else F.col("row_count") > limits.max_rows
    too_large = F.lit(False) if limits.max_bytes is None else F.coalesce(F.col("byte_size") > limits.max_bytes, F.lit(False))
    problem = (
        F.when(too_large, "BYTE_LIMIT_EXCEEDED")
        .when(F.col("column_count") == 0, "NO_HEADER_ROW")
        .when(too_wide, "COLUMN_LIMIT_EXCEEDED")
        .when(too_long, "ROW_LIMIT_EXCEEDED")
    )
    no_notices = F.array().cast("array<struct<code:string,n:bigint>>")
    return shapes.select(
        "file", "column_count", "row_count", "ragged_rows", "byte_size", problem.alias("problem"),
        # a refused file has no rows to tell about
        F.when(problem.isNull(), F.coalesce("notices", no_notices)).otherwise(no_notices).alias("notices"),
        problem.isNull().alias("can_run"),
    )


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: SHA-256 and size of every file, for files that fit into one cell (2 GB)."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.sha2("content", 256).alias("content_sha256"), F.col("length").alias("byte_size")
    )


LEAF_LINES, NODE_CHILDREN = 1_000, 1_000


def tree_fingerprints(lines: DataFrame) -> DataFrame:
    """SRC-07 for files of any size: (file, tree_sha256, lines) from (file, block, mono, line).

    A leaf is the digest of up to `LEAF_LINES` lines of a block of the file, written as digests of the
    lines joined in order; a node is the digest of up to `NODE_CHILDREN` digests below it. Blocks
    follow each other by their place in the file, so a file is hashed by as many tasks as read it.
    """
    placed = lines.select("file", "block", F.sha2("line", 256).alias("digest"), "mono")
    first = placed.groupBy("file", "block").agg(F.min("mono").alias("from"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = first.withColumn("before", before).drop("n")
    numbered = placed.join(broadcast_if_small(starts), ["file", "block"]).select(
        "file", (F.col("mono") - F.col("from") + F.col("before")).alias("i"), "digest", F.lit(1).cast("bigint").alias("lines")
    )
    level, children = numbered, LEAF_LINES
    while True:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"])
        level = level.groupBy("file", F.floor(F.col("i") / children).alias("i")).agg(
            F.sha2(F.array_join(ordered, ""), 256).alias("digest"), F.sum("lines").alias("lines")
        )
        level, children = materialize(level, "tree-digests"), NODE_CHILDREN
        if level.agg(F.max("i")).first()[0] in (None, 0):  # one node per file is left
            return level.select("file", F.col("digest").alias("tree_sha256"), "lines")


def row_digest(df: DataFrame) -> Column:
    """MD5 of a row: every cell with its length, so that no two rows are written alike."""
    cells = [F.col("`" + c.replace("`", "``") + "`").cast("string") for c in df.columns]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells]).cast("binary"))


def table_fingerprint(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """SRC-07: an order-free fingerprint of the rows, one row per `keys` (of the whole table without).

    Two exclusive ors, a sum and a count over 128-bit row digests: equal for any order of the same
    rows, different when a row is doubled (the ors cancel, sum and count do not). Parts merge by
    `merged`, so a table's fingerprint follows from those of its files.
    """
    own = df.select(*[c for c in df.columns if c not in (keys or [])])
    part = lambda start, digits: F.conv(F.substring("_digest", start, digits), 16, 10).cast("bigint")
    rows = df.select(*(keys or []), row_digest(own).alias("_digest"))
    return rows.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(part(1, 15)), F.lit(0).cast("bigint")).alias("xor_high"),
        F.coalesce(F.bit_xor(part(16, 15)), F.lit(0).cast("bigint")).alias("xor_low"),
        F.coalesce(F.sum(part(1, 8).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest_sum"),
    )


def merged(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fingerprints of parts -> the fingerprint of all their rows."""
    return parts.groupBy(*(keys or [])).agg(
        F.sum("rows").alias("rows"), F.bit_xor("xor_high").alias("xor_high"), F.bit_xor("xor_low").alias("xor_low"),
        F.sum("digest_sum").cast("decimal(38,0)").alias("digest_sum"),
    )


def notices(warnings: DataFrame) -> DataFrame:
    """SRC-12: warnings(code, seen_at) -> the six most common codes, ties by first seen."""
    return (
        warnings.groupBy("code")
        .agg(F.count(F.lit(1)).alias("n"), F.min("seen_at").alias("first_seen"))
        .orderBy(F.desc("n"), "first_seen")
        .limit(MAX_NOTICES)
        .select("code", "n")
    )


def ingest_facts(warnings: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-13 for many datasets: exact totals per code, and the first references as rows.

    warnings(…keys, code, reference, n) -> one row per dataset and code with the exact total.
    """
    codes = (
        "parsing.empty_column_name",
        "parsing.ragged_row",
        "parsing.xlsx_formula_without_cached_value",
        "parsing.xlsx_error_value",
    )
    return (
        warnings.where(F.col("code").isin(*codes))
        .groupBy(*keys, "code")
        .agg(F.sum("n").alias("total"), F.count_distinct("reference").alias("references"))
    )


def first_references(warnings: DataFrame, keys: list[str], limit: int = MAX_REFERENCES) -> DataFrame:
    """The first distinct references per dataset and code (a per-partition group limit)."""
    distinct = warnings.where(F.col("reference").isNotNull()).select(*keys, "code", "reference").distinct()
    rank = F.row_number().over(W.partitionBy(*keys, "code").orderBy("reference"))
    return distinct.withColumn("rank", rank).where(F.col("rank") <= limit)
