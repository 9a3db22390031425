"""Spelling variants by search schemes over a two-way FM-index of the delimited vocabulary.

Two words are near if one inserted, deleted or replaced code point turns one into the other. The
single error lies in one half of a word, so the other half is found exactly: the first scheme
matches the left half and goes on to the right allowing one error, the second matches the right
half and goes on to the left. Each direction has its own index, of the words as they are and of
the words reversed; the schemes are mirror images, so one search serves both. The second scheme
leaves out what begins with the left half, as the first has found it: no pair is met twice.

The vocabulary is sorted and cut into shards of about `SHARD_WORDS` words; a shard is indexed as
one text `|word|word|...|`. Words that share a half are neighbours in the order, so a query visits
the shards between the two ends of its half: one or two, more only where more words than a shard
holds share it. A task indexes one shard and streams the queries that visit it. A shard that many
queries visit is dealt to several tasks, so no task has more than about `CELL_QUERIES` queries.
An interval of suffix ranks is extended by one code point with two binary searches among the
places of that code point, for all queries of a batch at once.

Words are counted by Python dictionaries bounded to `FLUSH_WORDS` entries before the shuffle.

Defined cases: a null text has no words; a null id is hashed as the empty text; repeated rows
count as often as they occur; an empty table has no words.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rowlens.llm import words as w
from rowlens.llm.ship import by_value
from rowlens.sources.scratch import materialize

by_value(__name__)

MIN_LENGTH, MIN_COUNT, FORM_TIMES = 6, 5, 5
DAMAGE = 199  # one run in so many loses a code point
FLUSH_WORDS = 200_000
SHARD_WORDS, CELL_QUERIES = 4_096, 16_384
PIECE_BYTES = 1 << 18
_LAST = "\U0010ffff"

# --- words ---------------------------------------------------------------------------------------

_CODES = np.arange(256)
_ASCII = ((_CODES >= 0x41) & (_CODES <= 0x5A)) | ((_CODES >= 0x61) & (_CODES <= 0x7A))
_LEAD = 0xC3  # of U+00C0 to U+00FF in UTF-8, and of nothing else


def _runs(data: np.ndarray) -> Iterator[list[bytes]]:
    """The lower-cased runs of letters of a UTF-8 text, in pieces of about `PIECE_BYTES` bytes."""
    lead = data == _LEAD
    wanted = _ASCII[data] | lead
    wanted[1:] |= lead[:-1]
    text = np.where(wanted, w.LOWER[data], 0x20).astype(np.uint8).tobytes()
    begin = 0
    while begin < len(text):
        end = begin + PIECE_BYTES
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[begin:end].split()
        begin = end


def _without(run: bytes, h: int) -> bytes:
    """A run without the code point that the hash names."""
    points = run.decode()
    at = h % len(points)
    return (points[:at] + points[at + 1 :]).encode()


def text_words(doc_id: str, data: np.ndarray, least: int = MIN_LENGTH, damage: int = DAMAGE) -> Iterator[list[bytes]]:
    """The words of a text, damaged where the hash of id and run says so."""
    seed = crc32(f"{doc_id}:".encode())
    for found in _runs(data):
        runs = [x for x in found if len(x) >= least]  # bytes, never fewer than code points
        hashes = np.fromiter(map(crc32, runs, repeat(seed)), np.uint32, len(runs))
        for i in np.flatnonzero(hashes % damage == 0):
            runs[i] = _without(runs[i], int(hashes[i]))
        yield runs


def vocabulary(docs: DataFrame, least: int = MIN_LENGTH, least_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of (doc_id, text) that have `least` code points and occur often enough."""

    def table(found: Counter) -> pa.RecordBatch:
        kept = {k: n for k, n in found.items() if len(k) - k.count(_LEAD) >= least}
        words = pa.array(list(kept), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(kept.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for block in w.blocks(batch.column(1)):
                for i in range(block.rows):
                    own = block.data[block.offsets[i] : block.offsets[i + 1]]
                    for words in text_words(ids[block.first + i], own, least):
                        found.update(words)
                        if len(found) > FLUSH_WORDS:
                            yield table(found)
                            found.clear()
        if found:
            yield table(found)

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counts = named.mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- index ---------------------------------------------------------------------------------------


class Index:
    """FM-index of `|word|word|...|` that extends a match to the right by one code point.

    It is the index of the reversed text, whose suffixes begin with the last code point matched.
    Code points are numbered by their order in the shard, the delimiter is 0.
    """

    def __init__(self, words: list[str]):
        points = np.frombuffer("|".join(["", *words, ""]).encode("utf-32-le"), np.uint32)[::-1]
        inner = points != ord("|")
        self.symbols = np.unique(points[inner])
        codes = np.zeros(len(points), np.int64)
        codes[inner] = np.searchsorted(self.symbols, points[inner]) + 1
        self.size, self.alphabet = len(codes), len(self.symbols) + 1
        order = self._sorted_suffixes(codes)
        self.before = codes[order - 1]  # the symbol that follows the match in the word, per suffix rank
        # places of each symbol among these, symbol after symbol: one search gives the next rank
        self.places = np.sort(self.before * (self.size + 1) + np.arange(self.size))
        # the match of a whole word ends with the delimiter after it; which word that is
        delimiters = np.flatnonzero(codes == 0)
        self.word_at = np.full(self.size, -1, np.int64)
        number = len(words) - 1 - np.arange(len(delimiters))  # delimiter j of the reversed text precedes word n-1-j
        ranks = np.empty(self.size, np.int64)
        ranks[order] = np.arange(self.size)
        self.word_at[ranks[delimiters]] = number

    @staticmethod
    def _sorted_suffixes(codes: np.ndarray) -> np.ndarray:
        """Suffix array of the text read as a ring, by prefix doubling."""
        n = len(codes)
        rank, width = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
        while True:
            key = rank * (n + 1) + np.roll(rank, -width)
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = new
            width *= 2
            if new[-1] == n - 1 or width > 2 * n:
                return order

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words one after another, -1 where the shard has no such symbol, and offsets."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.symbols, points), len(self.symbols) - 1)
        return np.where(self.symbols[at] == points, at + 1, -1), np.concatenate(([0], np.cumsum(lengths)))

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank intervals after one more symbol; a symbol of -1 gives an empty interval."""
        base = symbol * (self.size + 1)
        new_low, new_high = np.searchsorted(self.places, base + low), np.searchsorted(self.places, base + high)
        return new_low, np.where(symbol < 0, new_low, new_high)

    def followers(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the interval, symbol) of the code points that follow a match, each once."""
        size = high - low
        wide = size > self.alphabet
        narrow = np.flatnonzero(~wide & (size > 0))
        count = size[narrow]
        owner = np.repeat(narrow, count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        seen = self.before[low[owner] + inside]
        every = np.arange(1, self.alphabet)
        owner = np.concatenate((owner, np.repeat(np.flatnonzero(wide), len(every))))
        seen = np.concatenate((seen, np.tile(every, int(wide.sum()))))
        pairs = np.unique((owner * self.alphabet + seen)[seen > 0])
        return pairs // self.alphabet, pairs % self.alphabet

    def near(self, words: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query, number of the indexed word) of words that begin with the query's
        first `halves` code points and differ from it by one error behind these."""
        symbols, first = self.encode(words)
        length = np.diff(first)
        n = len(words)
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        low, high = self.extend(low, high, np.zeros(n, np.int64))  # the delimiter before the word
        query = np.arange(n)
        for j in range(int(halves.max()) if n else 0):
            on = np.flatnonzero((j < halves[query]) & (high > low))
            low[on], high[on] = self.extend(low[on], high[on], symbols[first[query[on]] + j])
            # intervals that ran empty, or whose half is matched, stay as they are
        alive = high > low
        clean = (query[alive], halves[alive], low[alive], high[alive])
        wrong = tuple(np.empty(0, np.int64) for _ in range(4))
        found = []
        # a state is (query, code points of it used, interval); every turn uses one code point of each
        while len(clean[0]) or len(wrong[0]):
            # states with their one error: they end, or go on exactly
            q, at, lo, hi = wrong
            done = at == length[q]
            end_lo, end_hi = self.extend(lo[done], hi[done], np.zeros(int(done.sum()), np.int64))
            whole = end_hi > end_lo
            found.append(np.stack((q[done][whole], self.word_at[end_lo[whole]])))
            on = ~done
            q, at, lo, hi = q[on], at[on], lo[on], hi[on]
            lo, hi = self.extend(lo, hi, symbols[first[q] + at])
            alive = hi > lo
            going = (q[alive], at[alive] + 1, lo[alive], hi[alive])
            # states without an error: all errors that the index knows a word for, and none
            q, at, lo, hi = clean
            ended = at == length[q]
            owner, symbol = self.followers(lo, hi)
            expected = np.where(ended[owner], -1, symbols[np.minimum(first[q[owner]] + at[owner], len(symbols) - 1)])
            new_lo, new_hi = self.extend(lo[owner], hi[owner], symbol)
            inserted = (q[owner], at[owner], new_lo, new_hi)
            other = ~ended[owner] & (symbol != expected)
            replaced = tuple(x[other] for x in (q[owner], at[owner] + 1, new_lo, new_hi))
            on = ~ended
            deleted = (q[on], at[on] + 1, lo[on], hi[on])
            q, at, lo, hi = q[on], at[on], lo[on], hi[on]
            lo, hi = self.extend(lo, hi, symbols[first[q] + at])
            alive = hi > lo
            clean = (q[alive], at[alive] + 1, lo[alive], hi[alive])
            wrong = tuple(np.concatenate(x) for x in zip(going, inserted, replaced, deleted, strict=True))
            if len(wrong[0]) > 4 * n:  # repeats of one code point lead to the same state in several ways
                wrong = tuple(np.unique(np.stack(wrong), axis=1))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
        return pairs[0], pairs[1]


# --- search over the cluster ---------------------------------------------------------------------


def _halves(words: list[str], reverse: bool) -> np.ndarray:
    """Code points matched exactly: of the left half, or of the right half for reversed words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return lengths - lengths // 2 if reverse else lengths // 2


def _search(index: Index, known: list[str], counts: np.ndarray, words: list[str], reverse: bool) -> pa.RecordBatch:
    """Per query of one batch: how many near words the shard has and the best of them."""
    halves = _halves(words, reverse)
    query, other = index.near(words, halves)
    if reverse:
        # found by the first scheme already: the left half of the query begins the word as well
        left = [x[h:] for x, h in zip(words, halves.tolist(), strict=True)]
        new = np.fromiter((not known[b].endswith(left[a]) for a, b in zip(query.tolist(), other.tolist(), strict=True)), bool, len(query))
        query, other = query[new], other[new]
    forward = [x[::-1] for x in known] if reverse else known
    ordinal = np.empty(len(forward), np.int64)
    ordinal[np.array(sorted(range(len(forward)), key=forward.__getitem__), np.int64)] = np.arange(len(forward))
    order = np.lexsort((ordinal[other], -counts[other], query))
    query, other = query[order], other[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, np.int64)
    n_near = np.diff(np.append(first, len(query)))
    best = other[first]
    own = [words[i][::-1] if reverse else words[i] for i in query[first].tolist()]
    return pa.RecordBatch.from_arrays(
        [pa.array(own, pa.string()), pa.array(n_near, pa.int64()), pa.array(counts[best], pa.int64()), pa.array([forward[i] for i in best.tolist()], pa.string())],
        ["word", "n_near", "form_n", "form"],
    )


def _visits(least: list[str], reverse: bool):
    """Shards that a word visits: those between the two ends of its exact half."""

    def visit(words: pa.Array) -> pa.Array:
        out = []
        for word in words.to_pylist():
            half = word[: len(word) - len(word) // 2] if reverse else word[: len(word) // 2]
            begin = max(0, bisect_right(least, half) - 1)
            out.append(list(range(begin, max(begin + 1, bisect_left(least, half + _LAST)))))
        return pa.array(out, pa.list_(pa.int32()))

    return arrow_udf(visit, "array<int>")


def _one_way(words: DataFrame, reverse: bool, shard_words: int, cell_queries: int) -> DataFrame:
    """(word, n_near, form_n, form): what one scheme finds, a row per word and shard with a match."""
    name = "reversed" if reverse else "forward"
    keyed = words.select(F.reverse("word").alias("word") if reverse else F.col("word"), "n")
    total = keyed.count()
    shards = max(1, math.ceil(total / shard_words))
    sorted_ = keyed.repartitionByRange(shards, "word").withColumn("shard", F.spark_partition_id())
    sorted_ = materialize(sorted_, f"spelling-{name}")
    ends = sorted_.groupBy("shard").agg(F.min("word").alias("least")).orderBy("shard").collect()  # one row per shard
    least, numbers = [r["least"] for r in ends], [r["shard"] for r in ends]
    position = F.create_map(*[x for i, s in enumerate(numbers) for x in (F.lit(s), F.lit(i))]) if numbers != list(range(len(numbers))) else None
    indexed = sorted_ if position is None else sorted_.withColumn("shard", position[F.col("shard")])
    queries = materialize(indexed.select("word", F.explode(_visits(least, reverse)("word")).alias("shard")), f"spelling-{name}-queries")
    visits = {r["shard"]: r["n"] for r in queries.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per shard
    parts = [max(1, math.ceil(visits.get(i, 0) / cell_queries)) for i in range(len(least))]
    first = [sum(parts[:i]) for i in range(len(parts))] if len(parts) < 2_000 else np.concatenate(([0], np.cumsum(parts)[:-1])).tolist()
    cells = words.sparkSession.createDataFrame(list(zip(range(len(parts)), first, parts, strict=True)), "shard int, first int, parts int")
    cells = F.broadcast(cells)
    blank = F.lit(None).cast("bigint")
    whole = indexed.join(cells, "shard").select(
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("cell"), F.lit(0).alias("asks"), "word", "n"
    )
    asked = queries.join(cells, "shard").select(
        (F.col("first") + F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).alias("cell"), F.lit(1).alias("asks"), "word", blank.alias("n")
    )
    dealt = whole.unionByName(asked).repartition(max(1, sum(parts)), "cell").sortWithinPartitions("cell", "asks", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, known, counts, index = None, [], [], None
        for batch in batches:
            cells_, asks, texts, ns = (c.to_pylist() for c in batch.columns)
            begin = 0
            while begin < len(cells_):
                if cells_[begin] != cell:
                    cell, known, counts, index = cells_[begin], [], [], None
                end = bisect_right(cells_, cell, begin)
                split = bisect_left(asks, 1, begin, end)
                known += texts[begin:split]
                counts += ns[begin:split]
                if split < end:
                    if index is None:
                        index, weights = Index(known), np.array(counts, np.int64)
                    yield _search(index, known, weights, texts[split:end], reverse)
                begin = end

    return dealt.mapInArrow(run, "word string, n_near bigint, form_n bigint, form string")


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """(word, n, n_near, near, near_n) of `words` (word, n): how many words are near, and the one of
    largest n among them (null if none; ties: the smallest in code-point order)."""
    words = materialize(words, "spelling-words")
    if words.isEmpty():
        nothing = F.lit(None)
        return words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), nothing.cast("string").alias("near"), nothing.cast("bigint").alias("near_n"))
    both = _one_way(words, False, shard_words, cell_queries).unionByName(_one_way(words, True, shard_words, cell_queries))
    met = both.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best")
    )
    found = words.join(met, "word", "left")
    return found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.col("best.form").alias("near"), (-F.col("best.less")).alias("near_n"),
    )


def forms(near: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of `near`: a word's form is its near word, if that is
    `times` times as frequent; its root is the last word that following forms leads to.

    n grows `times`-fold with every step, so the number of doubling joins is known beforehand.
    """
    is_form = F.col("near_n") >= times * F.col("n")
    found = near.select(
        "word", F.when(is_form, F.col("near")).alias("form"), "n", "n_near", F.when(is_form, F.col("near_n")).alias("form_n")
    )
    found = materialize(found, "spelling-forms")
    most = found.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.floor(math.log(most, times)) + 1) if times > 1 else 64
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, shard_words: int = SHARD_WORDS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of `docs` (doc_id, text)."""
    return forms(near_words(vocabulary(docs.select("doc_id", "text")), shard_words, cell_queries))
