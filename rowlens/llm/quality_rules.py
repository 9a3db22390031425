"""Quality rules with thresholds taken from the corpus, per language and source.

Fixed cutoffs fail where languages and sources differ, so each measure's cutoff follows its own
distribution among the texts that pass the base rules. A measure is the rate of some case, smoothed
by half a case in one more place: (cases + 1/2) / (places + 1). Texts without a case then have small
rates that follow their lengths, and a measure that most texts lack still has quartiles of its own.

The fence of a group is its upper quartile times the spread to the power `SPREADS`, where the spread
is the ratio of upper quartile to median: all in factors, so junk below a quarter of a group does
not lift it. The spread is drawn to the mean spread of the language's sources and this to that of the
corpus, and may not exceed theirs to the power `LIFT`. No fixed cutoff and no slack is added. A text
is rejected if even the lower bound of its rate (`ERRORS` standard errors of its number of cases
below) lies beyond the fence, so one repeat in three lines is no junk.

The sketch is a table of logarithmic buckets (relative error `ACCURACY`): buckets of two groups
merge by adding counts, so a group too small to speak for itself is judged by the merged sketch of
its language, and that of the whole corpus after it. Sketch rows are bounded by groups x measures
x about 1,000 buckets whatever the input, and counting is combined before the shuffle, so one
source with a third of all rows is no hot key.

Defined cases: a null text has no words and fails; an empty table gives an empty result; null
languages and sources form groups of their own; further columns are kept by `judge`, and columns
it adds take the prefix given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rowlens.llm import words as w
from rowlens.llm.ship import by_value
from rowlens.sources.scratch import materialize

by_value(__name__)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct", "n_adjacent")
REPEAT_WINDOW = 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
_DIGIT = (np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)
_MARKS = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_LEAD = (np.arange(256) & 0xC0) != 0x80


def measure(block: w.Block) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    data = block.data
    found = w.spans(block, w.NOT_BLANK)
    hashes = w.span_hashes(data, found.starts, found.ends)
    grams = w.gram_hashes(hashes, REPEAT_WINDOW)
    begin = w.windows(found, REPEAT_WINDOW)
    keys = w.with_row(grams[begin], found.rows[begin])
    inside = w.covered(len(found), begin[w.repeated(keys)], REPEAT_WINDOW)

    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (found.rows[1:] == found.rows[:-1]))

    lines = w.spans(block, w.NOT_NEWLINE)
    wordy = np.zeros(len(data) + 1, np.int64)
    np.cumsum(w.NOT_BLANK[data], out=wordy[1:])
    keep = wordy[lines.ends] > wordy[lines.starts]
    rows = lines.rows[keep]
    line_keys = w.with_row(w.span_hashes(data, lines.starts[keep], lines.ends[keep]), rows)
    n = block.rows
    n_lines = np.bincount(rows, minlength=n)
    return {
        "n_words": found.counts,
        "word_chars": block.per_row(w.NOT_BLANK[data] & _LEAD[data]),
        "n_symbols": block.per_row(SYMBOLS[data]),
        "n_dup_lines": n_lines - _distinct(line_keys, rows, n),
        "n_repeat_words": np.bincount(found.rows[inside], minlength=n),
        "n_lines": n_lines,
        "n_upper": block.per_row(_UPPER[data]),
        "n_marks": block.per_row(_MARKS[data]),
        "n_digits": block.per_row(_DIGIT[data]),
        "n_distinct": _distinct(w.with_row(hashes, found.rows), found.rows, n),
        "n_adjacent": np.bincount(found.rows[again], minlength=n),
    }


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(keys, return_index=True)
    return np.bincount(rows[first], minlength=n)


def _struct(texts: pa.Array) -> pa.Array:
    parts = [measure(b) for b in w.blocks(texts)]
    columns = [
        np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64)
        for c in COUNTS
    ]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], list(COUNTS))


def text_counts(text: Column) -> Column:
    """Struct of counts of a text column."""
    kind = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"

    def counts(texts: pa.Array) -> pa.Array:
        return _struct(texts)

    # called nondeterministic, no filter or join draws a second evaluation below the first
    return arrow_udf(counts, kind).asNondeterministic()(text)


# --- mergeable quantile sketch ------------------------------------------------------------------

ACCURACY = 0.02
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
ZERO_BUCKET = -1_000_000


def bucket(value: Column) -> Column:
    """Bucket b holds (gamma^(b-1), gamma^b]; values of zero have their own."""
    log = F.ceil(F.log(value) / F.log(F.lit(_GAMMA))).cast("int")
    return F.when(value > 1e-9, log).otherwise(F.lit(ZERO_BUCKET))


def bucket_value(b: Column) -> Column:
    return F.when(b == ZERO_BUCKET, F.lit(0.0)).otherwise(
        F.lit(2.0) * F.pow(F.lit(_GAMMA), b) / F.lit(_GAMMA + 1)
    )


def sketch(measures: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """Rows (groups, measure, bucket, n): a quantile sketch per group, merged by adding n."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in names])
    return (
        measures.select(*groups, F.inline(pairs))
        .groupBy(*groups, "measure", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles(sketched: DataFrame, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """One row per group and measure with its row count and the wanted quantiles.

    A sketch has a bounded number of buckets, so its running sum fits one window.
    """
    from pyspark.sql import Window

    part = Window.partitionBy(*groups, "measure")
    running = part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketched.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n")).select(
        *groups, "measure", "bucket", F.sum("n").over(running).alias("_upto"), F.sum("n").over(part).alias("_all")
    )
    value = bucket_value(F.col("bucket"))
    return ranked.groupBy(*groups, "measure").agg(
        F.max("_all").alias("n"),
        *[F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(q)), value)).alias(k) for k, q in shares.items()],
    )


# --- rules --------------------------------------------------------------------------------------

# measure -> its cases and the places where they may occur
CASES = {
    "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "adjacent": ("n_adjacent", "n_words"),
    "upper": ("n_upper", "word_chars"), "marks": ("n_marks", "n_words"),
}
SPREADS, LIFT = 5.0, 1.5
ERRORS = 1.64  # one-sided, 95 %
MIN_GROUP = 200
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SHARES = {"q50": 0.5, "q75": 0.75}
BROADCAST_GROUPS = 50_000  # a few hundred bytes each


def measures(counts: str, errors: float = 0.0) -> dict[str, Column]:
    """Smoothed rates from a struct column of counts, or their bounds `errors` standard errors below."""
    c = lambda name: F.col(f"{counts}.{name}").cast("double")
    out = {}
    for name, (cases, places) in CASES.items():
        found = c(cases) + F.lit(0.5)
        least = F.greatest(found - F.lit(errors) * F.sqrt(found), F.lit(0.0)) if errors else found
        out[name] = least / (c(places) + F.lit(1.0))
    return out


def base_failed(counts: str) -> Column:
    n, repeats = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)


def _shrunk(own: Column, n: Column, parent: Column, min_group: int) -> Column:
    """A group's spread drawn to its parent's as by `min_group` more texts, at most `LIFT` times that."""
    return F.least((n * own + min_group * parent) / (n + min_group), LIFT * parent)


def thresholds(measured: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Fence per (lang, source, measure), from the quantiles of the smoothed rates.

    A group with fewer than `min_group` documents takes the fence of its language, and a small
    language that of the corpus, each by the quantiles of its merged sketch.
    """
    fine = materialize(sketch(measured, ["lang", "source"], list(CASES)), "quality-sketch")

    def level(groups: list[str], prefix: str) -> DataFrame:
        found = quantiles(fine, groups, SHARES)
        top, middle = F.log("q75"), F.log("q50")
        return found.select(
            *[F.col(g).alias(prefix + g) for g in groups], F.col("measure").alias(f"{prefix}measure"), F.col("n").alias(f"{prefix}n"),
            top.alias(f"{prefix}top"), (top - middle).alias(f"{prefix}spread"),
        )

    own = level(["lang", "source"], "")
    by_lang, overall = level(["lang"], "_l"), level([], "_o")
    # the spread inside sources: what lies between sources is no spread of any of them
    inside = F.sum(F.col("n") * F.col("spread")) / F.sum("n")
    inside_lang = own.groupBy(F.col("lang").alias("_ilang"), F.col("measure").alias("_imeasure")).agg(inside.alias("_lang_inside"))
    inside_all = own.groupBy(F.col("measure").alias("_jmeasure")).agg(inside.alias("_all_inside"))
    of_lang = _shrunk(F.col("_lang_inside"), F.col("_ln"), F.col("_all_inside"), min_group)
    of_group = _shrunk(F.col("spread"), F.col("n"), of_lang, min_group)
    fence = (
        F.when(F.col("n") >= min_group, F.col("top") + SPREADS * of_group)
        .when(F.col("_ln") >= min_group, F.col("_ltop") + SPREADS * F.col("_lspread"))
        .otherwise(F.col("_otop") + SPREADS * F.col("_ospread"))
    )
    return (
        own.join(by_lang, F.col("lang").eqNullSafe(F.col("_llang")) & (F.col("measure") == F.col("_lmeasure")))
        .join(inside_lang, F.col("lang").eqNullSafe(F.col("_ilang")) & (F.col("measure") == F.col("_imeasure")))
        .join(overall, F.col("measure") == F.col("_omeasure"))
        .join(inside_all, F.col("measure") == F.col("_jmeasure"))
        .select("lang", "source", "measure", F.exp(fence).alias("fence"))
    )


def judge(docs: DataFrame, prefix: str = "_q_", min_group: int = MIN_GROUP) -> DataFrame:
    """`docs` with struct `{prefix}counts`, boolean `{prefix}base_failed` and `{prefix}kept`.

    Texts are read twice, for the fences and for the verdicts, and nowhere written.
    """
    counts, key = f"{prefix}counts", f"{prefix}group"
    counted = docs.withColumn(counts, text_counts(F.col("text")))
    rates, least = measures(counts), measures(counts, ERRORS)
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    measured = counted.where(~base_failed(counts)).select(
        lang.alias("lang"), source.alias("source"), *[v.alias(k) for k, v in rates.items()]
    )
    fences = (
        thresholds(measured, min_group)
        .groupBy("lang", "source")
        .agg(F.map_from_entries(F.collect_list(F.struct("measure", "fence"))).alias("fences"))
        .select(F.struct("lang", "source").alias(key), F.col("fences").alias(f"{prefix}fences"))
    )
    fences = materialize(fences, "quality-fences")
    if fences.count() <= BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    over = [F.coalesce(v > F.col(f"{prefix}fences")[k], F.lit(False)) for k, v in least.items()]
    failed = base_failed(counts)
    beyond = over[0]
    for o in over[1:]:
        beyond = beyond | o
    # the documents are dealt by group only where there are more groups than are broadcast
    return (
        counted.withColumn(key, F.struct(lang.alias("lang"), source.alias("source")))
        .join(fences, key, "left")
        .withColumn(f"{prefix}base_failed", failed)
        .withColumn(f"{prefix}kept", ~failed & ~beyond)
        .drop(key, f"{prefix}fences")
    )
