"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

A text is reduced to counts: words of three lexicons, the densest stretch of them, lexicon words
close to a second person, capitals, marks, and lexicon words in disguise (signs for letters,
stretched letters, letters set apart). Fixed lexicons miss what they do not list, so the labels add
words: a word weighs the log odds of label 1 of the texts it is in, less `ERRORS` standard errors,
and counts where that is above zero in `LEAST_ROWS` texts or more. A training row is fitted with
weights from the half of the training rows that it is not in, so that no row meets its own label;
every row is scored with the weights of all. The trees see rates of the counts and the strongest
weights of a text, not the words. Trees are fitted on three quarters of the
training rows; on the other quarter isotonic regression turns their margin into a probability. Where a class has
fewer than `MIN_ROWS` rows on either side, both are fitted on all training rows.

Words are weighed over all labelled training rows; at most `MOST_WORDS`, the heaviest, are broadcast. The
counts and words of labelled training rows are written once and both fits read them. `SAMPLE_ROWS` bounds the labelled rows that
are fitted, chosen by a hash of the id; every row is scored. The calibration reads one row per
margin, rounded to `MARGIN_STEP`.

Defined cases: a null or empty text has no words and rates of zero; repeated labels count as often
as they occur; labels other than 0 and 1, and null ids, teach nothing; with fewer than `MIN_ROWS`
rows of a class every score is the share of label 1 (0 without labels); a row of `docs` stays one
row; columns of any name are kept, those added begin with `_toxic_`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rowlens.llm import words as w
from rowlens.llm.ship import by_value
from rowlens.sources.scratch import materialize

by_value(__name__)

# fixed values: words as they are written, lower case, in English, German, French and Spanish
INSULTS = """
idiot idiots moron morons stupid dumb loser losers trash garbage worthless pathetic disgusting scum clown clowns
imbecile fool fools jerk creep freak pig coward liar vermin filth filthy ugly brainless useless
dummkopf trottel versager abschaum widerlich armselig nichtsnutz drecksack
imbécile débile minable ordure pourriture dégoûtant crétin
idiota estúpido estúpida imbécil basura asqueroso patético escoria
""".split()
PROFANE = "damn crap shit fuck fucking fucked bullshit bastard bitch ass asshole scheiße arschloch merde putain mierda puta".split()
THREATS = "kill die hurt punch beat destroy burn hang shoot stab töten sterben tuer crève matar muere".split()
SECOND_PERSON = """
you your yours yourself yourselves ya u ur du dich dir dein deine euch euer tu toi ton tes vous votre vos tú ti
usted ustedes vosotros
""".split()

COUNTS = (
    "n_words", "n_insults", "n_profane", "n_threats", "n_peak", "n_you", "n_directed", "n_letters", "n_upper",
    "n_shouted", "n_marks", "n_mark_runs", "n_disguised", "n_stretched", "n_spelled", "n_mixed",
)
NEAR_WORDS, PEAK_WORDS, SPELLED_LETTERS = 5, 30, 4
SAMPLE_ROWS, MIN_ROWS, NODE_ROWS = 200_000, 10, 10
TREES, DEPTH, STEP, SEED = 20, 3, 0.2, 7
MARGIN_STEP, RAW_SHARE = 0.01, 0.01
LEAST_ROWS, ERRORS, MOST_WORDS, TOP = 3, 1.0, 100_000, 3
BROADCAST_KEYS = 2_000_000  # labels, 16 bytes each
WEIGHTS = ("weight", "other_0", "other_1")  # of all training rows, and for rows of half 0 and 1

_B = np.arange(256)
_UPPER = (_B >= 0x41) & (_B <= 0x5A)
_LETTERS = ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)  # of lower-cased text
_MARKS = np.isin(_B, np.frombuffer(b"!?", np.uint8))
# signs that stand for a letter
_SIGNS = {"@": "a", "4": "a", "0": "o", "$": "s", "5": "s", "1": "i", "!": "i", "3": "e", "7": "t"}
_SIGN = np.isin(_B, [ord(x) for x in _SIGNS])
_UNSIGNED = np.array([ord(_SIGNS.get(chr(b), chr(b))) if b < 128 else b for b in _B], np.uint8)


def _hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of words, made the way `words.span_hashes` makes them."""
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) for x in words])
    return np.unique(w.span_hashes(data, ends - [len(x.encode()) for x in words], ends))


def _single(word: str) -> str:
    """A word with each letter that repeats written once."""
    return "".join(x for i, x in enumerate(word) if i == 0 or word[i - 1] != x)


_OFFENSIVE = INSULTS + PROFANE
_TABLES = {
    "insults": _hashes(INSULTS), "profane": _hashes(PROFANE), "threats": _hashes(THREATS), "you": _hashes(SECOND_PERSON),
    "offensive": _hashes(_OFFENSIVE), "single": _hashes([_single(x) for x in _OFFENSIVE]),
}


def _among(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


def _running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _words_and_hashes(block: w.Block) -> tuple[w.Spans, np.ndarray]:
    found = w.spans(block, _LETTERS)
    return found, w.span_hashes(block.data, found.starts, found.ends)


def _disguised(low: w.Block) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lexicon words with signs for letters, and words with a sign between letters."""
    plain = w.Block(low.first, _UNSIGNED[low.data], low.offsets)
    found, hashes = _words_and_hashes(plain)
    signs = _running(_SIGN[low.data])
    has_sign = signs[found.ends] > signs[found.starts]
    inner = has_sign & _LETTERS[low.data[found.starts]] & _LETTERS[low.data[found.ends - 1]]
    hits = has_sign & _among(hashes, _TABLES["offensive"])
    return np.bincount(found.rows[hits], minlength=low.rows), np.bincount(found.rows[inner], minlength=low.rows)


def _stretched(low: w.Block) -> np.ndarray:
    """Lexicon words with a letter three times in a row or more, per text."""
    data = low.data
    again = np.zeros(len(data), bool)
    again[1:] = (data[1:] == data[:-1]) & (data[1:] < 0x80)
    again[low.offsets[:-1][low.offsets[:-1] < len(data)]] = False
    triple = np.zeros(len(data), bool)
    triple[1:] = again[1:] & again[:-1]
    if not triple.any():
        return np.zeros(low.rows, np.int64)
    kept = np.flatnonzero(~again)
    once = w.Block(low.first, data[kept], np.searchsorted(kept, low.offsets))
    found, hashes = _words_and_hashes(once)
    where = np.append(kept, len(data))
    triples = _running(triple)
    hits = _among(hashes, _TABLES["single"]) & (triples[where[found.ends]] > triples[where[found.starts]])
    return np.bincount(found.rows[hits], minlength=low.rows)


def _spelled(low: w.Block, found: w.Spans) -> np.ndarray:
    """Lexicon words whose letters are set apart by one sign or blank each, per text."""
    alone = np.flatnonzero(found.ends - found.starts == 1)
    if len(alone) < SPELLED_LETTERS:
        return np.zeros(low.rows, np.int64)
    starts, rows = found.starts[alone], found.rows[alone]
    joined = (starts[1:] - starts[:-1] == 2) & (rows[1:] == rows[:-1])
    begin = np.flatnonzero(np.append(True, ~joined))
    end = np.append(begin[1:], len(alone))
    hashes = w.span_hashes(low.data[starts], begin, end)
    hits = (end - begin >= SPELLED_LETTERS) & _among(hashes, _TABLES["offensive"])
    return np.bincount(rows[begin[hits]], minlength=low.rows)


def measure(block: w.Block) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    low = block.lowered()
    return _measured(block, low, *_words_and_hashes(low))


def _measured(block: w.Block, low: w.Block, found: w.Spans, hashes: np.ndarray) -> dict[str, np.ndarray]:
    n = block.rows
    per_text = lambda mask: np.bincount(found.rows[mask], minlength=n)
    is_a = {k: _among(hashes, _TABLES[k]) for k in ("insults", "profane", "threats", "you", "offensive")}

    hits = np.flatnonzero(is_a["offensive"])
    peak = np.zeros(n, np.int64)
    if len(hits):
        last = found.first[found.rows[hits] + 1]  # the end of the hit's text
        upto = np.searchsorted(hits, np.minimum(hits + PEAK_WORDS, last))
        np.maximum.at(peak, found.rows[hits], upto - np.arange(len(hits)))
    you = np.flatnonzero(is_a["you"])
    first, last = found.first[found.rows[hits]], found.first[found.rows[hits] + 1]
    close = np.searchsorted(you, np.minimum(hits + NEAR_WORDS + 1, last)) > np.searchsorted(you, np.maximum(hits - NEAR_WORDS, first))

    upper = _UPPER[block.data]
    capitals = _running(upper)
    lengths = found.ends - found.starts
    shouted = (lengths >= 3) & (capitals[found.ends] - capitals[found.starts] == lengths)
    marks = w.spans(block, _MARKS)
    disguised, mixed = _disguised(low)
    return {
        "n_words": found.counts, "n_insults": per_text(is_a["insults"]), "n_profane": per_text(is_a["profane"]),
        "n_threats": per_text(is_a["threats"]), "n_peak": peak, "n_you": per_text(is_a["you"]),
        "n_directed": np.bincount(found.rows[hits[close]], minlength=n), "n_letters": low.per_row(_LETTERS[low.data]),
        "n_upper": block.per_row(upper), "n_shouted": per_text(shouted), "n_marks": block.per_row(_MARKS[block.data]),
        "n_mark_runs": np.bincount(marks.rows[marks.ends - marks.starts > 1], minlength=n),
        "n_disguised": disguised, "n_stretched": _stretched(low), "n_spelled": _spelled(low, found), "n_mixed": mixed,
    }


def word_sets(found: w.Spans, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each text as signed hashes, and where each text's begin (with the end)."""
    order = np.lexsort((hashes, found.rows))
    values, rows = hashes[order], found.rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new].view(np.int64), np.searchsorted(rows[new], np.arange(n + 1))


def strengths(words: np.ndarray, first: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per text: the heaviest word, the sum of the `TOP` heaviest, how many words weigh, and their share."""
    n = len(first) - 1
    out = np.zeros((n, 4))
    if not len(words) or not len(known):
        return out
    rows = np.repeat(np.arange(n), np.diff(first))
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    weight = np.where(known[at] == words, weights[at], 0.0)
    hits = np.flatnonzero(weight > 0)
    hits = hits[np.lexsort((-weight[hits], rows[hits]))]
    rows, weight = rows[hits], weight[hits]
    begin = np.searchsorted(rows, np.arange(n + 1))
    place = np.arange(len(rows)) - begin[rows]
    for column, most in ((0, 1), (1, TOP)):
        out[:, column] = np.bincount(rows[place < most], weight[place < most], minlength=n)
    out[:, 2] = np.diff(begin)
    out[:, 3] = out[:, 2] / np.maximum(np.diff(first), 1)
    return out


_KIND = ", ".join(f"{c}: bigint" for c in COUNTS)


def _texts(texts: pa.Array) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """The counts of texts, their words, and where each text's begin."""
    parts, words, sizes = [], [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
    for block in w.blocks(texts):
        low = block.lowered()
        found, hashes = _words_and_hashes(low)
        parts.append(_measured(block, low, found, hashes))
        values, first = word_sets(found, hashes, block.rows)
        words.append(values)
        sizes.append(np.diff(first))
    columns = [np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64) for c in COUNTS]
    return [pa.array(c) for c in columns], np.concatenate(words), np.cumsum(np.concatenate(sizes))


def text_words(text: Column) -> Column:
    """Struct of counts of a text column and its distinct words."""

    def counts(texts: pa.Array) -> pa.Array:
        columns, words, first = _texts(texts)
        sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words))
        return pa.StructArray.from_arrays([*columns, sets], [*COUNTS, "words"])

    return arrow_udf(counts, f"struct<{_KIND}, words: array<bigint>>")(text)


class Lexicon:
    """Words that speak for label 1: sorted hashes and, by name, their weights."""

    def __init__(self, taught: DataFrame, words: str = "_toxic_counts.words"):
        """`taught`: rows with `_half` (0 or 1), `_y` and words."""
        n = {(r["_half"], r["_y"]): r["n"] for r in taught.groupBy("_half", "_y").agg(F.count(F.lit(1)).alias("n")).collect()}
        cell = lambda h, y: F.sum(((F.col("_half") == h) & (F.col("_y") == y)).cast("bigint")).alias(f"n{h}{y}")
        counted = taught.select("_half", "_y", F.explode(words).alias("word")).groupBy("word").agg(*[cell(h, y) for h in (0, 1) for y in (0, 1)])

        def weight(*halves: int) -> Column:
            ones, zeros = (sum((F.col(f"n{h}{y}") for h in halves), F.lit(0.0)) for y in (1, 0))
            n1, n0 = (sum(n.get((h, y), 0) for h in halves) for y in (1, 0))
            odds = F.log((ones + 0.5) / (n1 + 1.0)) - F.log((zeros + 0.5) / (n0 + 1.0))
            sure = odds - ERRORS * F.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5))
            return F.when(ones >= LEAST_ROWS, F.greatest(sure, F.lit(0.0))).otherwise(0.0)

        weighed = counted.select("word", weight(0, 1).alias("weight"), weight(1).alias("other_0"), weight(0).alias("other_1"))
        heavy = weighed.withColumn("_most", F.greatest(*WEIGHTS)).where("_most > 0").orderBy(F.desc("_most"), "word").limit(MOST_WORDS)
        rows = sorted(heavy.select("word", *WEIGHTS).collect())
        self.words = np.array([r[0] for r in rows], np.int64)
        self.weights = {c: np.array([r[i + 1] for r in rows], np.float64) for i, c in enumerate(WEIGHTS)}

    def strengths(self, words: np.ndarray, first: np.ndarray, weights: str) -> np.ndarray:
        return strengths(words, first, self.words, self.weights[weights])


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def text_strengths(text: Column, lexicon) -> Column:
    """Struct of counts of a text column and the strengths of its words; `lexicon` is a broadcast one."""

    def counts(texts: pa.Array) -> pa.Array:
        columns, words, first = _texts(texts)
        return pa.StructArray.from_arrays([*columns, _lists(lexicon.value.strengths(words, first, "weight"))], [*COUNTS, "strengths"])

    return arrow_udf(counts, f"struct<{_KIND}, strengths: array<double>>")(text)


def other_strengths(words: str, half: str, lexicon) -> Column:
    """Strengths of word arrays by the weights of the half of the training rows that a row is not in."""

    def weigh(sets: pa.Array, halves: pa.Array) -> pa.Array:
        flat, mine = np.asarray(sets.flatten()), np.asarray(halves)
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.asarray(sets.value_lengths(), np.int64))))
        both = [lexicon.value.strengths(flat, first, c) for c in WEIGHTS[1:]]
        return _lists(np.where((mine == 0)[:, None], *both))

    return arrow_udf(weigh, "array<double>")(F.col(words), F.col(half))


def features(counts: str) -> Column:
    """Array of rates from a struct of counts."""
    c = lambda name: F.col(f"{counts}.n_{name}").cast("double")
    words, letters = F.greatest(c("words"), F.lit(1.0)), F.greatest(c("letters"), F.lit(1.0))
    hidden = c("disguised") + c("stretched") + c("spelled")
    offensive = c("insults") + c("profane") + hidden
    return F.array(
        c("insults") / words, c("profane") / words, c("threats") / words, F.log1p(offensive), c("peak"),
        c("directed") / words, c("directed") / F.greatest(offensive, F.lit(1.0)), c("you") / words, c("upper") / letters,
        c("shouted") / words, c("marks") / words, c("mark_runs") / words, hidden / words, c("mixed") / words,
    )


class Model:
    """Trees and calibration, or one share where a class has too few rows."""

    def __init__(self, trees, calibration, share: float):
        self.trees, self.calibration, self.share = trees, calibration, share

    def score(self, rows: DataFrame, x: str = "_toxic_x") -> DataFrame:
        """`rows` with `_toxic_score` instead of `x`."""
        if self.trees is None:
            return rows.withColumn("_toxic_score", F.lit(float(self.share))).drop(x)
        seen = self.trees.transform(rows.withColumn("_toxic_v", array_to_vector(x)))
        margin = seen.withColumn("_toxic_margin", vector_to_array("_toxic_raw")[1])
        known = self.calibration.transform(margin)
        # a little of the logistic keeps the order of rows within a step
        logistic = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.col("_toxic_margin")))
        score = (1 - RAW_SHARE) * F.col("_toxic_step") + RAW_SHARE * logistic
        return known.withColumn("_toxic_score", score).drop(x, "_toxic_v", "_toxic_raw", "_toxic_margin", "_toxic_step")


def fit(labelled: DataFrame, key: str, label: str, x: str = "_toxic_x", sample_rows: int = SAMPLE_ROWS) -> Model:
    """`labelled`: (key, x, label) of training rows; `key` deals them to trees and calibration."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        F.xxhash64(F.lit(SEED), key).alias("_deal"), F.col(label).cast("double").alias("_y"), array_to_vector(x).alias("_toxic_v")
    )
    total = rows.count()
    if total > sample_rows:
        rows = rows.where(F.pmod("_deal", F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    rows = materialize(rows.coalesce(max(1, min(total, sample_rows) // 25_000)), "toxic-training")
    of_trees = F.pmod(F.shiftright("_deal", 32), F.lit(4)) > 0
    counts = {(r["t"], r["_y"]): r["n"] for r in rows.groupBy(of_trees.alias("t"), "_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, every = sum(v for k, v in counts.items() if k[1] == 1.0), sum(counts.values())
    if min(ones, every - ones) < MIN_ROWS:
        return Model(None, None, ones / every if every else 0.0)
    apart = all(counts.get((t, y), 0) >= MIN_ROWS for t in (True, False) for y in (0.0, 1.0))
    for_trees, for_steps = (rows.where(of_trees), rows.where(~of_trees)) if apart else (rows, rows)
    booster = GBTClassifier(
        featuresCol="_toxic_v", labelCol="_y", predictionCol="",
        maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=NODE_ROWS, seed=SEED,
    )
    trees = booster.setRawPredictionCol("_toxic_raw").setProbabilityCol("").fit(for_trees)
    margin = F.round(vector_to_array("_toxic_raw")[1] / MARGIN_STEP) * MARGIN_STEP
    steps = trees.transform(for_steps).groupBy(margin.alias("_toxic_margin")).agg(
        F.avg("_y").alias("_y"), F.count(F.lit(1)).cast("double").alias("_n")
    )
    isotonic = IsotonicRegression(featuresCol="_toxic_margin", labelCol="_y", weightCol="_n", predictionCol="_toxic_step")
    return Model(trees, isotonic.fit(steps.coalesce(1)), ones / every)


def scored(docs: DataFrame, labels: DataFrame, key: str, label: str, teaches: Column) -> DataFrame:
    """`docs` (key, text, ...) with `_toxic_score`; rows with `teaches` learn from `labels` (key, label)."""
    marks = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("_y"))
    if marks.count() <= BROADCAST_KEYS:
        marks = F.broadcast(marks)
    half = F.pmod(F.shiftright(F.xxhash64(F.lit(SEED), key), 36), F.lit(2)).cast("int")
    own = docs.where(F.coalesce(teaches, F.lit(False))).select(key, "text").join(marks, key)
    taught = materialize(own.select(key, "_y", half.alias("_half"), text_words(F.col("text")).alias("_toxic_counts")), "toxic-words")
    lexicon = docs.sparkSession.sparkContext.broadcast(Lexicon(taught))
    others = other_strengths("_toxic_counts.words", "_half", lexicon)
    model = fit(taught.select(key, "_y", F.concat(features("_toxic_counts"), others).alias("_toxic_x")), key, "_y")
    known = docs.withColumn("_toxic_counts", text_strengths(F.col("text"), lexicon))
    known = known.withColumn("_toxic_x", F.concat(features("_toxic_counts"), F.col("_toxic_counts.strengths")))
    return model.score(materialize(known.drop("text", "_toxic_counts"), "toxic-features"))
