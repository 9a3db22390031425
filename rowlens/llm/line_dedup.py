"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

A document is the sequence of its lines that are not blank. In each round suffixes are ranked by
their first 2^k lines: the rank pair (first half, second half) is sorted in ranges over the
cluster and numbered in order, so ranks keep the order of suffixes. Suffixes of one rank are an
interval of the suffix array whose longest common prefix is at least 2^k lines. Only suffixes of
an interval with two members go on; the rounds end when none is left, after log2 of the longest
repeat.

A line goes if it lies in a run of lines that occurs earlier (by document id, then line) and that
has at least `min_lines` lines, or is one line of at least `min_chars` characters. Equality of
`min_lines` lines is equality of the two overlapping halves that a round has ranked.

`runs` walks the rounds from deep to shallow: a suffix is compared with the earliest one that shares
its deepest interval, and every round adds its lines where the ranks behind the common part agree.
What is left is the longest common prefix of the two, line for line; runs inside others are dropped.

Counts and first places are combined before the shuffle and come back by joins that split skewed
keys, so a line that owns a third of all rows is in no task's way.

Defined cases: a null text has no lines and stays null; blank lines are kept and do not end a run;
rows with equal id and text are one document and not copies of each other; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.sources.scratch import materialize

MIN_LINES, MIN_CHARS = 2, 40
BROADCAST_KEYS = 2_000_000
BROADCAST_BYTES = 32 << 20
_PLACE = ("doc_id", "_kid", "i")


def with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_kid", F.xxhash64("doc_id", "text"))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lines(keyed: DataFrame) -> DataFrame:
    """(doc_id, _kid, i, line, h1, h2, chars) of every line that is not blank; `i` counts these."""
    numbered = F.transform(split_lines(F.col("text")), lambda x, j: F.struct(j.alias("line"), x.alias("body")))
    full = F.filter(numbered, lambda x: x["body"].rlike("[^\\x20\\x09-\\x0D]"))
    return (
        keyed.select("doc_id", "_kid", F.posexplode(full).alias("i", "l"))
        .select(
            "doc_id", "_kid", "i", "l.line", F.xxhash64("l.body").alias("h1"), F.xxhash64(F.lit(1), "l.body").alias("h2"),
            F.length("l.body").alias("chars"),
        )
    )


def _ranked(suffixes: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, rank, first): intervals of two and more suffixes; `rank` keeps the order of `by`."""
    found = (
        suffixes.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*_PLACE)).alias("first"))
        .where("_n > 1")
        .select(*by, "first")
    )
    # partitions follow each other in order, and so do the numbers given inside and across them
    ordered = found.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialize(ordered.withColumn("rank", F.monotonically_increasing_id()), label)


def _with_follower(suffixes: DataFrame, distance: int) -> DataFrame:
    """Adds `second`: the rank of the suffix `distance` lines on, null if there is none."""
    ahead = Window.partitionBy("doc_id", "_kid").orderBy("i").rangeBetween(distance, distance)
    return suffixes.withColumn("second", F.max("rank").over(ahead))


def intervals(keyed: DataFrame) -> list[DataFrame]:
    """Per round k the suffixes (doc_id, _kid, i, line, chars, rank, later, source) whose 2^k lines
    occur twice; `later` if an earlier suffix shares them, `source` being the earliest."""
    every = materialize(lines(keyed), "dedup-lines")
    ranks = _ranked(every, ["h1", "h2"], "dedup-ranks")
    out, distance, by, source = [], 1, ["h1", "h2"], every
    while not ranks.isEmpty():
        later = F.struct(*_PLACE) != F.col("first")
        kept = source.join(ranks, by).select(*_PLACE, "line", "chars", "rank", later.alias("later"), F.when(later, F.col("first")).alias("source"))
        now = materialize(_with_follower(kept, distance), "dedup-suffixes")
        out.append(now)
        source = now.where("second IS NOT NULL").withColumnRenamed("rank", "half")
        by = ["half", "second"]
        ranks = _ranked(source, by, "dedup-ranks")
        distance *= 2
    return out


def _at(rows: DataFrame, doc_id: str, kid: str, i: Column, ranks: DataFrame, into: str) -> DataFrame:
    """`rows` with the rank, in one round, of the suffix at (doc_id, kid, i); null if it has none there."""
    right = ranks.select(F.col("doc_id").alias("_d"), F.col("_kid").alias("_k"), F.col("i").alias("_i"), F.col("rank").alias(into))
    same = (F.col(kid) == F.col("_k")) & (i == F.col("_i")) & F.col(doc_id).eqNullSafe(F.col("_d"))
    return rows.join(right, same, "left").drop("_d", "_k", "_i")


def _windows(rounds: list[DataFrame], size: int) -> DataFrame:
    """(doc_id, _kid, i) of windows of `size` lines that an earlier window equals."""
    k = size.bit_length() - 1
    if k >= len(rounds):
        return rounds[0].where("false").select(*_PLACE) if rounds else None
    if size == 1 << k:
        return rounds[k].where("later").select(*_PLACE)
    # two windows of 2^k lines that overlap cover the size
    both = _at(rounds[k].select(*_PLACE, "rank"), "doc_id", "_kid", F.col("i") + (size - (1 << k)), rounds[k], "_end")
    both = both.where("_end IS NOT NULL")
    first = both.groupBy("rank", "_end").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return both.join(first, ["rank", "_end"]).where(F.struct(*_PLACE) != F.col("first")).select(*_PLACE)


def runs(rounds: list[DataFrame]) -> DataFrame | None:
    """(doc_id, _kid, i, line, size, source) of the maximal runs of lines that occur earlier: `size`
    lines that are not blank from number `i` on (at line `line`) equal those at `source`."""
    if not rounds:
        return None
    deepest = None
    for k, suffixes in enumerate(rounds):
        found = suffixes.where("later").select(*_PLACE, "line", F.lit(k).alias("k"), "source")
        deepest = found if deepest is None else deepest.unionByName(found)
    best = deepest.groupBy(*_PLACE).agg(F.max_by(F.struct("line", "k", "source"), "k").alias("b")).select(*_PLACE, "b.*")
    # a suffix that goes on where its predecessor's source goes on belongs to the predecessor's run
    one_back = Window.partitionBy("doc_id", "_kid").orderBy("i")
    before, at = F.lag(F.struct("i", "source")).over(one_back), F.col("source")
    follows = (
        (F.col("before.i") == F.col("i") - 1) & (F.col("before.source._kid") == at["_kid"])
        & (F.col("before.source.i") == at["i"] - 1) & F.col("before.source.doc_id").eqNullSafe(at["doc_id"])
    )
    state = best.withColumn("before", before).where(~F.coalesce(follows, F.lit(False))).drop("before")
    state = materialize(state.withColumn("size", F.expr("shiftleft(1, k)")).withColumn("_d0", at["doc_id"]).withColumn("_k0", at["_kid"]), "dedup-runs")
    for j in range(len(rounds) - 2, -1, -1):
        ranks = rounds[j].select(*_PLACE, "rank")
        walked = _at(state, "doc_id", "_kid", F.col("i") + F.col("size"), ranks, "_here")
        walked = _at(walked, "_d0", "_k0", F.col("source.i") + F.col("size"), ranks, "_there")
        more = F.coalesce((F.col("_here") == F.col("_there")) & (F.col("k") > j), F.lit(False))
        state = materialize(walked.withColumn("size", F.col("size") + F.when(more, 1 << j).otherwise(0)).drop("_here", "_there"), "dedup-runs")
    ends = F.max(F.col("i") + F.col("size")).over(one_back.rowsBetween(Window.unboundedPreceding, -1))
    return (
        state.withColumn("_upto", ends).where(F.coalesce(F.col("i") + F.col("size") > F.col("_upto"), F.lit(True)))
        .select(*_PLACE, "line", "size", "source")
    )


def removals(keyed: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, _kid, gone, copied_depth, runs): per document with copied lines the line numbers to
    delete, the largest 2^k such that 2^k lines in a row occur earlier, and its maximal runs."""
    if min_lines < 1:
        raise ValueError("min_lines counts from 1")
    rounds = intervals(keyed)
    place = "doc_id {0}, _kid bigint".format(keyed.schema["doc_id"].dataType.simpleString())
    nothing = keyed.sparkSession.createDataFrame(
        [], f"{place}, line int, depth bigint, run struct<line: int, size: int, source_id: {keyed.schema['doc_id'].dataType.simpleString()}, source_i: int>"
    )
    if not rounds:
        return nothing.groupBy("doc_id", "_kid").agg(
            F.array_sort(F.collect_set("line")).alias("gone"), F.max("depth").alias("copied_depth"), F.array_sort(F.collect_list("run")).alias("runs")
        )
    no_line, no_run, no_depth = F.lit(None).cast("int").alias("line"), F.lit(None).cast(nothing.schema["run"].dataType).alias("run"), F.lit(None).cast("bigint").alias("depth")
    marked = nothing
    for k, suffixes in enumerate(rounds):
        later = suffixes.where("later")
        line = F.when(F.col("chars") >= min_chars, F.col("line")).alias("line") if k == 0 else no_line
        marked = marked.unionByName(later.select("doc_id", "_kid", line, F.lit(1 << k).cast("bigint").alias("depth"), no_run))
    # a window of min_lines lines: each of its lines goes; lines between blanks keep their numbers
    gone = _window_lines(rounds[0], _windows(rounds, min_lines), min_lines)
    marked = marked.unionByName(gone.select("doc_id", "_kid", "line", no_depth, no_run))
    run = F.struct("line", "size", F.col("source.doc_id").alias("source_id"), F.col("source.i").alias("source_i")).alias("run")
    marked = marked.unionByName(runs(rounds).select("doc_id", "_kid", no_line, no_depth, run))
    return marked.groupBy("doc_id", "_kid").agg(
        F.array_sort(F.collect_set("line")).alias("gone"), F.max("depth").alias("copied_depth"), F.array_sort(F.collect_list("run")).alias("runs")
    )


def _window_lines(first_round: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """The lines of windows of `size` lines; each of them is in the first round, as it is repeated."""
    inside = windows.select(*_PLACE, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_step"))
    wanted = inside.select("doc_id", "_kid", (F.col("i") + F.col("_step")).alias("i")).distinct()
    right = wanted.select(F.col("doc_id").alias("_d"), F.col("_kid").alias("_k"), F.col("i").alias("_i"))
    same = (F.col("_kid") == F.col("_k")) & (F.col("i") == F.col("_i")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    return first_round.join(right, same).select("doc_id", "_kid", "line")


def without_lines(text: Column, gone: Column) -> Column:
    """The text is split once: inside the outer lambda its lines are a value."""
    kept = lambda every: F.array_except(F.sequence(F.lit(0), F.size(every) - 1), gone)
    return F.transform(F.array(split_lines(text)), lambda every: F.array_join(F.transform(kept(every), lambda j: every[j]), "\n"))[0]


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with `_kept` (text without later copies), `_gone` (line numbers, null if none),
    `_copied_depth` (0 if none) and `_runs` (line, size, source_id, source_i of the maximal runs that
    occur earlier, null if none). Texts without copies stay where they are."""
    keyed = with_key(docs)
    gone = materialize(removals(keyed.select("doc_id", "_kid", "text"), min_lines, min_chars), "dedup-gone")
    few = gone.select("_kid").distinct()
    if few.count() <= BROADCAST_KEYS:  # 8 bytes each
        few = F.broadcast(few)
    right = gone.select(
        F.col("doc_id").alias("_d"), F.col("_kid").alias("_k"), F.col("gone").alias("_gone"), F.col("copied_depth").alias("_copied_depth"),
        F.col("runs").alias("_runs"),
    )
    # about the bytes of a row: key, line numbers, runs
    row_bytes = 64 + 4 * F.size("gone") + 48 * F.size("runs")
    if (gone.agg(F.sum(row_bytes.cast("bigint"))).first()[0] or 0) <= BROADCAST_BYTES:  # else the texts are dealt to them
        right = F.broadcast(right)
    same = (F.col("_kid") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    touched = keyed.join(few, "_kid", "left_semi").join(right, same, "left").drop("_d", "_k")
    touched = touched.withColumn(
        "_kept", F.when(F.size(F.coalesce("_gone", F.array().cast("array<int>"))) > 0, without_lines(F.col("text"), F.col("_gone"))).otherwise(F.col("text"))
    )
    rest = (
        keyed.join(few, "_kid", "left_anti")
        .withColumn("_gone", F.lit(None).cast("array<int>"))
        .withColumn("_copied_depth", F.lit(None).cast("bigint"))
        .withColumn("_runs", F.lit(None).cast(gone.schema["runs"].dataType))
        .withColumn("_kept", F.col("text"))
    )
    both = touched.unionByName(rest).withColumn("_copied_depth", F.coalesce("_copied_depth", F.lit(0).cast("bigint")))
    return both.drop("_kid")
