"""Repeated passages by seed and extend over winnowed anchors.

A window of `WINDOW` words owns one anchor: the leftmost smallest hash among its k-grams. Equal
windows own equal anchors at the same place, so a passage repeats only where anchors do, and only
anchors that occur twice are looked at again. Seeds are extended both ways in two steps. First
each occurrence is extended over all windows that own it; where the whole extension occurs again,
as inside a long repeat, all its windows are repeats and one comparison settled them. What is left
are the ends of repeats: there every window is compared with the windows of the same anchor, of
the occurrences left over and of one occurrence of each settled extension. Joined windows give
the maximal repeats.

No pairs of occurrences are formed: equality is counted per (anchor, content hash), which is
combined before the shuffle, and brought back by joins that split skewed keys. Two passages are
equal if two hashes of 64 bits over differently hashed words agree.

Defined cases: a null text has no words; texts under `WINDOW` words keep all; identical rows
repeat each other; ids may be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm import words as w
from rowlens.llm.ship import by_value
from rowlens.sources.scratch import materialize

by_value(__name__)

WINDOW, GRAM = 50, 8
BROADCAST_KEYS = 2_000_000
_FACTOR = np.uint64(0xD6E8FEB86659FD95)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))


class Anchored:
    """Anchor occurrences of a block: word index, own windows [first, last] and the words' sums."""

    def __init__(self, block: w.Block, window: int, gram: int):
        self.words = found = w.spans(block, w.NOT_BLANK)
        self.window = window
        seeds = w.span_hashes(block.data, found.starts, found.ends)
        self.content = w.span_hashes(block.data, found.starts, found.ends, seed=1)
        begin = w.windows(found, window)
        grams = w.gram_hashes(seeds, gram)
        at = _leftmost_least(grams, window - gram + 1)[begin]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        where = np.flatnonzero(new)
        self.at = at[where]
        self.first = begin[where]
        self.last = begin[np.append(where[1:], len(begin)) - 1] if len(begin) else begin
        self.seed = grams[self.at]
        self.rows = found.rows[self.at]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Content hash of the words from start to end."""
        n = len(self.content)
        with np.errstate(over="ignore"):
            if not hasattr(self, "_sums"):
                powers = np.full(n, _FACTOR, np.uint64)
                powers[:1] = 1
                self._inverse = np.full(n + 1, _INVERSE, np.uint64)
                self._inverse[0] = 1
                self._inverse = np.cumprod(self._inverse)
                self._sums = np.zeros(n + 1, np.uint64)
                np.cumsum(self.content * np.cumprod(powers), out=self._sums[1:])
            part = (self._sums[end] - self._sums[start]) * self._inverse[start]
            return w.mix(part + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def extensions(self) -> np.ndarray:
        """Hash of all words of an occurrence's own windows and of the anchor's place in them."""
        whole = self.hashes(self.first, self.last + self.window)
        with np.errstate(over="ignore"):
            return w.mix(whole + (self.at - self.first).astype(np.uint64))


def _leftmost_least(values: np.ndarray, size: int) -> np.ndarray:
    """Index of the leftmost smallest of every `size` neighbours."""
    if len(values) < size:
        return np.empty(0, np.int64)

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    best, reach = np.arange(len(values)), 1
    while 2 * reach <= size:
        best = better(best[:-reach], best[reach:])
        reach *= 2
    if reach < size:
        n = len(values) - size + 1
        best = better(best[:n], best[size - reach : size - reach + n])
    return best


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _repeated_seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in w.blocks(batch.column("text")):
                seeds, n = np.unique(Anchored(block, window, gram).seed, return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(seeds), pa.array(n)], ["seed", "n"])

    counted = docs.select("text").mapInArrow(run, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").select("seed")


def _occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, kid, seed, extension, first, last); first and last count words of the document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in w.blocks(batch.column("text")):
                a = Anchored(block, window, gram)
                own = batch.slice(block.first, block.rows)
                base = a.words.first[a.rows]
                rows = pa.array(a.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id").take(rows), own.column("kid").take(rows), _long(a.seed), _long(a.extensions()),
                        pa.array((a.first - base).astype(np.int32)), pa.array((a.last - base).astype(np.int32)),
                    ],
                    ["doc_id", "kid", "seed", "extension", "first", "last"],
                )

    schema = f"doc_id {id_type}, kid bigint, seed bigint, extension bigint, first int, last int"
    return docs.select("doc_id", "kid", "text").mapInArrow(run, schema)


def _own_windows(wanted: DataFrame, window: int) -> DataFrame:
    """(oid, seed, hashes, weight) of rows (text, places: array of (oid, seed, first, last, weight))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            for block in w.blocks(batch.column("text")):
                a = object.__new__(Anchored)
                a.words = w.spans(block, w.NOT_BLANK)
                a.content = w.span_hashes(block.data, a.words.starts, a.words.ends, seed=1)
                mine = places.slice(block.first, block.rows)
                flat = mine.flatten()
                sizes = np.asarray(pc.fill_null(pc.list_value_length(mine), 0))
                base = np.repeat(a.words.first[:-1], sizes)
                first = np.asarray(flat.field("first")) + base
                n = np.asarray(flat.field("last")) - np.asarray(flat.field("first")) + 1
                ends = np.zeros(len(n) + 1, np.int32)
                np.cumsum(n, out=ends[1:])
                start = np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)
                hashes = a.hashes(start, start + window)
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("oid"), flat.field("seed"), flat.field("weight"),
                        pa.ListArray.from_arrays(pa.array(ends), _long(hashes)),
                    ],
                    ["oid", "seed", "weight", "hashes"],
                )

    return wanted.select("text", "places").mapInArrow(run, "oid bigint, seed bigint, weight int, hashes array<bigint>")


def with_key(docs: DataFrame) -> DataFrame:
    """Rows with equal id and text share a key."""
    return docs.withColumn("kid", F.xxhash64("doc_id", "text"))


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of `docs` whose (doc_id, kid) occurs in `keys`; texts stay in place if the keys are few."""
    few = keys.select("kid").distinct()
    if few.count() <= BROADCAST_KEYS:  # 8 bytes each
        return docs.join(F.broadcast(few), "kid", "left_semi")
    return docs.join(few, "kid", "left_semi")


def _by_key(docs: DataFrame, found: DataFrame, column: str, how: str) -> DataFrame:
    """`docs` joined with a column of `found` (doc_id, kid, column)."""
    right = found.select(F.col("doc_id").alias("_doc_id"), F.col("kid").alias("_kid"), column)
    return docs.join(right, (F.col("kid") == F.col("_kid")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), how)


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, kid, runs): per document with repeats, sorted (first, end) word ranges of them.

    `docs`: (doc_id, kid, text). A range may touch or overlap the next one.
    """
    seeds = materialize(_repeated_seeds(docs, window, gram), "repeat-seeds")
    found = _occurrences(docs, window, gram).join(seeds, "seed").withColumn("oid", F.monotonically_increasing_id())
    found = materialize(found, "repeat-occurrences")
    whole = materialize(
        found.groupBy("seed", "extension").agg(F.count(F.lit(1)).alias("times"), F.min("oid").alias("oid")), "repeat-extensions"
    )
    settled = whole.where("times > 1")
    # a seed is open while one of its extensions occurs once
    open_seeds = whole.where("times = 1").select("seed").distinct()
    compared = whole.join(open_seeds, "seed", "left_semi").select("oid", F.least("times", F.lit(2)).cast("int").alias("weight"))
    places = (
        found.join(compared, "oid")
        .groupBy("doc_id", "kid")
        .agg(F.collect_list(F.struct("oid", "seed", "first", "last", "weight")).alias("places"))
    )
    places = materialize(places, "repeat-places")
    texts = _texts_of(docs, places).dropDuplicates(["doc_id", "kid"])
    wanted = _by_key(texts, places, "places", "inner").select("text", "places")
    hashed = materialize(_own_windows(wanted, window), "repeat-windows")
    each = hashed.select("oid", "seed", "weight", F.posexplode("hashes").alias("at", "hash"))
    twice = each.groupBy("seed", "hash").agg(F.sum("weight").alias("n")).where("n > 1").select("seed", "hash")
    ends = each.where("weight = 1").join(twice, ["seed", "hash"]).groupBy("oid").agg(F.collect_list("at").alias("ats"))
    by_end = found.join(ends, "oid").select("doc_id", "kid", F.explode("ats").alias("at"), "first")
    by_end = by_end.select("doc_id", "kid", (F.col("first") + F.col("at")).alias("first"), (F.col("first") + F.col("at") + window).alias("end"))
    by_whole = found.join(settled.select("seed", "extension"), ["seed", "extension"]).select(
        "doc_id", "kid", "first", (F.col("last") + window).alias("end")
    )
    return (
        by_whole.unionByName(by_end)
        .groupBy("doc_id", "kid")
        .agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("runs"))
    )


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): a row per row of `docs` (doc_id, text); `kept` are the
    words left, joined by single spaces."""
    keyed = with_key(docs.select("doc_id", "text"))
    runs = materialize(repeats(keyed, window, gram), "repeat-runs")
    return _removed(keyed, runs, lambda kept: pa.array([k.decode() for k in kept], pa.string()), "kept string")


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """As `remove`, with the SHA-256 of the kept words instead of the words."""
    keyed = with_key(docs.select("doc_id", "text"))
    runs = materialize(repeats(keyed, window, gram), "repeat-runs")
    return _removed(
        keyed, runs, lambda kept: pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept_sha256 string"
    )


def _removed(keyed: DataFrame, runs: DataFrame, shown, column: str) -> DataFrame:
    touched = _by_key(_texts_of(keyed, runs), runs, "runs", "left").select("doc_id", "text", "runs")
    few = runs.select("kid").distinct()
    if few.count() <= BROADCAST_KEYS:
        few = F.broadcast(few)
    rest = keyed.join(few, "kid", "left_anti").select("doc_id", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    return _cut(touched, shown, column).unionByName(_cut(rest, shown, column))


def _cut(rows: DataFrame, shown, column: str) -> DataFrame:
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in w.blocks(batch.column("text")):
                found = w.spans(block, w.NOT_BLANK)
                mine = batch.column("runs").slice(block.first, block.rows)
                flat = mine.flatten()
                sizes = np.asarray(pc.fill_null(pc.list_value_length(mine), 0))
                base = np.repeat(found.first[:-1], sizes)
                gone = np.zeros(len(found), bool)
                if len(flat):
                    change = np.zeros(len(found) + 1, np.int64)
                    np.add.at(change, np.asarray(flat.field("first")) + base, 1)
                    np.add.at(change, np.asarray(flat.field("end")) + base, -1)
                    gone = np.cumsum(change[:-1]) > 0
                removed = np.bincount(found.rows[gone], minlength=block.rows)
                # each kept word brings one space; the last one of a text is cut off
                data = np.append(block.data, np.uint8(0x20))
                ends = found.ends[~gone]
                rows_ = found.rows[~gone]
                taken, offsets = w.span_bytes(data, found.starts[~gone], ends + 1)
                if len(taken):
                    taken = taken.copy()
                    taken[offsets[1:] - 1] = 0x20
                first = np.searchsorted(rows_, np.arange(block.rows + 1))
                whole = taken.tobytes()
                kept = [whole[offsets[a] : max(offsets[b] - 1, offsets[a])] for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, block.rows), pa.array(found.counts.astype(np.int64)),
                        pa.array(removed.astype(np.int64)), shown(kept),
                    ],
                    ["doc_id", "n_words", "n_removed", column.split()[0]],
                )

    return rows.select("doc_id", "text", "runs").mapInArrow(run, f"doc_id {id_type}, n_words bigint, n_removed bigint, {column}")
