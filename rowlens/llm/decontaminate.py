"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton recognises every run of words of every item. Streaming a text through it gives, at
each word, the longest run of item words that ends there; a run of `window` words or more marks
its last `window` words as hit, and so does a whole item that is shorter. A text only enters the
automaton where two words in a row occur in a row in some item, found by array look-ups; outside
such stretches the longest match is at most one word.

The items are dealt to blocks of about `BLOCK_CHARS` characters, one automaton each, so that a larger
benchmark takes more scans of the texts and not more memory. Nothing is rewritten for a block: each
scan returns only the texts that it hits, by a key, and these few rows are joined back once.
With one block, texts are matched and cut in one pass and never shuffled.

Defined cases: a null text has no words; an item without words is ignored; items that repeat an
id count once; an item without an id is called by the empty string; without items nothing is hit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rowlens.llm import words as w
from rowlens.llm.ship import by_value
from rowlens.sources.scratch import materialize

by_value(__name__)

WINDOW = 13
BLOCK_CHARS = 800_000
COVERAGE_PERCENT = 5
KIND = "n_words: bigint, runs: array<struct<first: bigint, last: bigint>>, items: array<string>"
BROADCAST_KEYS = 2_000_000


@dataclass
class Automaton:
    """States are substring classes; `step` maps (state, word) to the next state."""

    window: int
    step: dict[tuple[int, int], int] = field(default_factory=dict)
    longest: list[int] = field(default_factory=lambda: [0])
    suffix: list[int] = field(default_factory=lambda: [-1])
    leaving: list[list[int]] = field(default_factory=lambda: [[]])
    whole: dict[int, dict[int, set[str]]] = field(default_factory=dict)  # state -> length -> short items
    holding: dict[int, set[str]] = field(default_factory=dict)  # state of a window -> items

    def _state(self, longest: int, suffix: int, leaving: list[int]) -> int:
        self.longest.append(longest)
        self.suffix.append(suffix)
        self.leaving.append(leaving)
        return len(self.longest) - 1

    def _link(self, state: int, word: int, to: int) -> None:
        if (state, word) not in self.step:
            self.leaving[state].append(word)
        self.step[state, word] = to

    def _split(self, state: int, word: int, below: int) -> int:
        """The state that holds exactly the strings of `below` that extend `state` by `word`."""
        if self.longest[below] == self.longest[state] + 1:
            return below
        part = self._state(self.longest[state] + 1, self.suffix[below], list(self.leaving[below]))
        for x in self.leaving[below]:
            self.step[part, x] = self.step[below, x]
        self.suffix[below] = part
        while state >= 0 and self.step.get((state, word)) == below:
            self.step[state, word] = part
            state = self.suffix[state]
        return part

    def add(self, item: list[int]) -> None:
        at = 0
        for word in item:
            known = self.step.get((at, word))
            if known is not None:
                at = self._split(at, word, known)
                continue
            new = self._state(self.longest[at] + 1, 0, [])
            state = at
            while state >= 0 and (state, word) not in self.step:
                self._link(state, word, new)
                state = self.suffix[state]
            if state >= 0:
                self.suffix[new] = self._split(state, word, self.step[state, word])
            at = new

    def matches(self, stretch):
        """(state, longest match ending here) after each word."""
        at, length = 0, 0
        for word in stretch:
            while (at, word) not in self.step and at:
                at = self.suffix[at]
                length = self.longest[at]
            at = self.step.get((at, word), 0)
            length = length + 1 if at else 0
            yield at, length

    def window_state(self, at: int) -> int:
        while self.longest[self.suffix[at]] >= self.window:
            at = self.suffix[at]
        return at

    def name(self, item: list[int], label: str) -> None:
        """Notes where an added item can be recognised."""
        for at, length in self.matches(item):
            if length >= self.window:
                self.holding.setdefault(self.window_state(at), set()).add(label)
        if len(item) < self.window:
            while self.longest[self.suffix[at]] >= len(item):
                at = self.suffix[at]
            self.whole.setdefault(at, {}).setdefault(len(item), set()).add(label)

    def hits(self, stretch):
        """(last word, words hit, items) of every window that occurs in the stretch."""
        for i, (at, length) in enumerate(self.matches(stretch)):
            if length >= self.window:
                yield i, self.window, self.holding[self.window_state(at)]
            if self.whole:
                state = at
                while state > 0:
                    for size, labels in self.whole.get(state, {}).items():
                        if size <= length:
                            yield i, size, labels
                    state = self.suffix[state]


@dataclass
class Matcher:
    """One block of items: word ids, known word pairs and the automaton."""

    vocabulary: np.ndarray
    seen: np.ndarray  # by the low bits of a word's hash
    pairs: np.ndarray
    shortest: int
    automaton: Automaton

    @staticmethod
    def build(items: list[tuple[str, str]], window: int = WINDOW) -> Matcher:
        hashed = []
        for label, text in items:
            for block in w.blocks(pa.array([text])):
                low = block.lowered()
                found = w.spans(low, w.ALNUM)
                if len(found):
                    hashed.append((label, w.span_hashes(low.data, found.starts, found.ends)))
        if not hashed:
            return Matcher(np.empty(0, np.uint64), np.zeros(1 << 16, bool), np.empty(0, np.int64), 1, Automaton(window))
        vocabulary = np.unique(np.concatenate([h for _, h in hashed]))
        automaton, pairs, ids = Automaton(window), [], []
        for label, h in hashed:
            item = np.searchsorted(vocabulary, h)
            pairs.append(item[:-1] * len(vocabulary) + item[1:])
            ids.append((label, item.tolist()))
            automaton.add(ids[-1][1])
        for label, item in ids:
            automaton.name(item, label)
        seen = np.zeros(1 << 16, bool)
        seen[vocabulary & np.uint64(0xFFFF)] = True
        shortest = min(window, *(len(i) for _, i in ids))
        return Matcher(vocabulary, seen, np.unique(np.concatenate(pairs)), shortest, automaton)

    def stretches(self, hashes: np.ndarray, rows: np.ndarray):
        """(first word, ids) of every stretch that may hold a window."""
        n, size = len(hashes), len(self.vocabulary)
        if not n or not size:
            return
        ids = np.full(n, -1, np.int64)
        maybe = np.flatnonzero(self.seen[hashes & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), size - 1)
        ids[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at, -1)
        joined = np.zeros(n, bool)  # word i follows word i - 1 in some item
        both = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0) & (rows[1:] == rows[:-1])) + 1
        if len(both) and len(self.pairs):
            pair = ids[both - 1] * size + ids[both]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both] = self.pairs[at] == pair
        firsts = np.flatnonzero((ids >= 0) & ~joined)
        ends = np.ones(n, bool)
        ends[:-1] = ~joined[1:]
        lasts = np.flatnonzero((ids >= 0) & ends) + 1
        for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
            if b - a >= self.shortest:
                yield a, ids[a:b].tolist()

    def find(self, texts: pa.Array, cut: bool = False) -> pa.Array:
        """Struct of n_words, runs and items, with `cut` also of the text that is left of texts with runs."""
        n_words, runs, items, left = [], [], [], []
        for block in w.blocks(texts):
            low = block.lowered()
            found = w.spans(low, w.ALNUM)
            own_runs: dict[int, list[dict]] = {}
            own_items: dict[int, set[str]] = {}
            hashes = w.span_hashes(low.data, found.starts, found.ends)
            for a, stretch in self.stretches(hashes, found.rows):
                row = int(found.rows[a])
                start = a - int(found.first[row])
                for i, size, labels in self.automaton.hits(stretch):
                    last = start + i + 1
                    mine = own_runs.setdefault(row, [])
                    # hits come by their last word, so a run can only grow or swallow earlier ones
                    first = last - size
                    while mine and mine[-1]["last"] >= first:
                        first = min(first, mine.pop()["first"])
                    mine.append({"first": first, "last": last})
                    own_items.setdefault(row, set()).update(labels)
            n_words.extend(found.counts.tolist())
            runs.extend(own_runs.get(r, []) for r in range(block.rows))
            items.extend(sorted(own_items.get(r, ())) for r in range(block.rows))
            if cut:
                left.extend(_left(block, found, r, own_runs[r]) if r in own_runs else None for r in range(block.rows))
        span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
        columns = [pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(span)), pa.array(items, pa.list_(pa.string()))]
        names = ["n_words", "runs", "items"]
        return pa.StructArray.from_arrays([*columns, pa.array(left, pa.string())] if cut else columns, [*names, "left"] if cut else names)


def _left(block: w.Block, words: w.Spans, row: int, runs: list[dict]) -> str:
    """A text without the bytes from the first to the last word of each run."""
    begin, first = int(block.offsets[row]), int(words.first[row])
    whole = block.data[begin : block.offsets[row + 1]]
    keep = np.ones(len(whole), bool)
    for run in runs:
        keep[words.starts[first + run["first"]] - begin : words.ends[first + run["last"] - 1] - begin] = False
    return whole[keep].tobytes().decode("utf-8")


def matched(text: Column, matcher: Matcher, cut: bool = False) -> Column:
    """Struct of n_words, runs of hit words (end exclusive), the items found and, with `cut`, the text left."""

    def find(texts: pa.Array) -> pa.Array:
        return matcher.find(texts, cut)

    # called so that the optimiser does not run it once for a filter and again for a projection
    return arrow_udf(find, f"struct<{KIND}{', left: string' if cut else ''}>").asNondeterministic()(text)


def _blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(label, text, _b) of the items, and how many blocks they make."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("label"), F.coalesce("text", F.lit("")).alias("text")
    )
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(chars) // BLOCK_CHARS))
    return items.withColumn("_b", F.pmod(F.xxhash64("label", "text"), F.lit(n))), n


def _matcher(dealt: DataFrame, block: int, window: int) -> Matcher:
    rows = dealt.where(F.col("_b") == block).select("label", "text").collect()  # about BLOCK_CHARS characters
    return Matcher.build([(r["label"], r["text"]) for r in rows], window)


def match(docs: DataFrame, benchmark: DataFrame, into: str = "_match", window: int = WINDOW, cut: bool = False) -> DataFrame:
    """`docs` with a struct of n_words, hit runs and items, with `cut` also the text left of texts
    with runs (`left`); `benchmark` has item_id and text."""
    dealt, n = _blocks(benchmark)
    if n == 1:
        return docs.withColumn(into, matched(F.col("text"), _matcher(dealt, 0, window), cut))
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("_mk"), "text")
    hits = None
    for b in range(n):
        one = texts.select("_mk", matched(F.col("text"), _matcher(dealt, b, window)).alias("_m")).where(F.size("_m.runs") > 0)
        one = one.select("_mk", F.lit(b).alias("b"), "_m.runs", "_m.items")
        hits = one if hits is None else hits.unionByName(one)
    hits = materialize(hits, "decontaminate-hits").dropDuplicates(["_mk", "b"])  # rows may repeat a text
    hits = hits.groupBy("_mk").agg(
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("_runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items")
    )
    hits = materialize(hits, "decontaminate-hits")
    if hits.count() <= BROADCAST_KEYS // 100:  # runs and items of a text are a few hundred bytes
        hits = F.broadcast(hits)
    counted = docs.withColumn("_m", matched(F.col("text"), Matcher.build([], window))).withColumn("_mk", F.xxhash64(F.coalesce("text", F.lit(""))))
    nothing = lambda kind: F.array().cast(kind)
    runs = F.coalesce("_runs", nothing("array<struct<first: bigint, last: bigint>>"))
    parts = [F.col("_m.n_words").alias("n_words"), runs.alias("runs"), F.coalesce("_items", nothing("array<string>")).alias("items")]
    if cut:
        parts.append(without_runs(F.when(F.size(runs) > 0, F.col("text")), runs).alias("left"))
    return counted.join(hits, "_mk", "left").withColumn(into, F.struct(*parts)).drop("_mk", "_m", "_runs", "_items")


def hit_words(runs: Column) -> Column:
    """Words in the union of the runs."""
    ordered = F.array_sort(runs)
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    return F.aggregate(
        ordered, zero,
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("bigint"), r["last"] - F.greatest(r["first"], s["upto"]))).alias("n"),
            F.greatest(s["upto"], r["last"]).alias("upto"),
        ),
    )["n"]


def contaminated(n_words: Column, n_hit: Column, percent: int = COVERAGE_PERCENT) -> Column:
    return (n_hit > 0) & (100 * n_hit >= percent * n_words)


def without_runs(text: Column, runs: Column) -> Column:
    """The text without the bytes from the first to the last word of each run."""

    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        places = found.to_pylist()
        for block in w.blocks(texts):
            words = w.spans(block.lowered(), w.ALNUM)
            for r in range(block.rows):
                valid = texts[block.first + r].is_valid
                out.append(_left(block, words, r, places[block.first + r] or []) if valid else None)
        return pa.array(out, pa.string())

    return arrow_udf(cut, "string")(text, runs)


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = COVERAGE_PERCENT) -> DataFrame:
    """Contaminated documents go; from others the hit runs are cut out. `docs` keeps its columns,
    `_text` is the text left."""
    found = match(docs, benchmark, cut=True)
    hit = hit_words(F.col("_match.runs"))
    left = F.when(F.size("_match.runs") > 0, F.col("_match.left")).otherwise(F.col("text"))
    return found.where(~contaminated(F.col("_match.n_words"), hit, percent)).withColumn("_text", left).drop("_match")
