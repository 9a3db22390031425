"""Document likelihood under a subword lattice.

A public vocabulary names the pieces; its scores (a piece's rank) give the first weights, and
expectation maximisation over the training words re-estimates them. A word, led by a space byte,
may be cut into pieces in every possible way; the forward recursion in log space adds up all of
them, so a document's score is its marginal probability and not that of one segmentation. Bytes
without a piece of their own have a byte piece, so no text is impossible.

Work follows distinct words, not tokens: words are counted once over all documents, expectations
and lattice scores are taken per distinct word, and documents get both scores back by word. Words
with more than 1/2^20 of all training tokens (at most 1,048,576 words, 24 bytes each) are
broadcast; every other word meets its documents in a join, where no key owns more than a
millionth of the training tokens. Expected counts are one row per piece, whatever the input.

Defined cases: a null or blank text is the end token alone; without training documents every count
is zero and the first weights stay; rows may repeat and ids may be null. Words are told apart by
64-bit hashes in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm import words as w
from rowlens.llm.ship import by_value
from rowlens.sources.scratch import materialize

by_value(__name__)

FREQUENT = 1 << 20
EM_ROUNDS = 2
PRIOR = 0.05
CHUNK_WORDS = 40_000
_BYTE_WEIGHT = 1e-4
_HASH = np.uint64(0x9E3779B97F4A7C15)
_BYTES = w.mix(np.arange(256, dtype=np.uint64) + np.uint64(901))


def vocabulary_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces that can occur in a word led by a space, and their first weights (summing to one)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ")
        if " " in piece[1:]:
            continue
        # a score is minus the rank
        weights[piece.encode()] = 1.0 / (10.0 - min(model.get_score(i), 0.0))
    least = min(weights.values(), default=1.0) * _BYTE_WEIGHT
    for b in range(256):
        weights.setdefault(bytes([b]), least)
    pieces = sorted(weights)
    values = np.array([weights[p] for p in pieces])
    return pieces, values / values.sum()


class Lattice:
    """Log probabilities of words as sums over all segmentations."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.log = np.log(weights)
        self.most = max(map(len, pieces))
        ids: dict[int, int] = {}
        with np.errstate(over="ignore"):
            for i, piece in enumerate(pieces):
                h = np.uint64(0)
                for n, b in enumerate(piece, 1):
                    h = h * _HASH + _BYTES[b]
                    key = int(w.mix(np.array([h + np.uint64(n)]))[0])
                    ids.setdefault(key, -1)
                ids[key] = i
        self.keys = np.array(sorted(ids), np.uint64)
        self.ids = np.array([ids[int(k)] for k in self.keys], np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys & np.uint64((1 << 20) - 1)] = True

    def with_weights(self, weights: np.ndarray) -> Lattice:
        other = object.__new__(Lattice)
        other.__dict__.update(self.__dict__)
        other.log = np.log(weights)
        return other

    def _edges(self, flat: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Piece that starts at byte i and has l + 1 bytes, at [l, i]; -1 if none. `upto`: word ends."""
        found = np.full((self.most, len(flat)), -1, np.int64)
        at = np.arange(len(flat))
        h = np.zeros(len(flat), np.uint64)
        for n in range(1, self.most + 1):
            keep = at + n <= upto[at]
            at, h = at[keep], h[keep]
            if not len(at):
                break
            with np.errstate(over="ignore"):
                h = h * _HASH + _BYTES[flat[at + n - 1]]
                key = w.mix(h + np.uint64(n))
            keep = self.seen[key & np.uint64((1 << 20) - 1)]
            at, h, key = at[keep], h[keep], key[keep]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            keep = self.keys[where] == key
            at, h = at[keep], h[keep]
            found[n - 1, at] = self.ids[where[keep]]
        return found

    def run(self, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray | None = None):
        """Log probability of each word; with counts also the expected uses of every piece."""
        lengths = np.diff(offsets) + 1  # with the leading space
        begin = np.zeros(len(lengths), np.int64)
        np.cumsum(lengths[:-1], out=begin[1:])
        total = int(lengths.sum())
        flat = np.full(total, 0x20, np.uint8)
        inner = np.ones(total, bool)
        inner[begin] = False
        flat[inner] = data[offsets[0] : offsets[-1]]
        upto = np.repeat(begin + lengths, lengths)
        pieces = self._edges(flat, upto)
        log = np.where(pieces >= 0, self.log[pieces], -np.inf)

        order = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[order]
        # place p of a word has alpha at begin + word number + p: one place more than bytes
        place = begin + np.arange(len(lengths))
        alpha = np.full(total + len(lengths), -np.inf)
        alpha[place] = 0.0
        longest = int(sorted_lengths[0])
        for j in range(1, longest + 1):
            active = order[: np.searchsorted(-sorted_lengths, -j, "right")]
            back = np.arange(1, min(j, self.most) + 1)[:, None]
            terms = alpha[place[active] + j - back] + log[back - 1, begin[active] + j - back]
            alpha[place[active] + j] = _log_sum(terms)
        score = alpha[place + lengths]
        if counts is None:
            return score, None
        beta = np.full(total + len(lengths), -np.inf)
        beta[place + lengths] = 0.0
        for j in range(1, longest + 1):
            active = order[: np.searchsorted(-sorted_lengths, -j, "right")]
            at = lengths[active] - j
            ahead = np.arange(1, min(j, self.most) + 1)[:, None]
            terms = beta[place[active] + at + ahead] + log[ahead - 1, begin[active] + at]
            beta[place[active] + at] = _log_sum(terms)
        l_, i_ = np.nonzero(pieces >= 0)
        word = np.repeat(np.arange(len(lengths)), lengths)[i_]
        weight = alpha[i_ + word] + log[l_, i_] + beta[i_ + word + l_ + 1] - score[word]
        uses = np.bincount(pieces[l_, i_], np.exp(weight) * counts[word], minlength=len(self.log))
        return score, uses


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=0)
    return top + np.log(np.exp(terms - top).sum(axis=0))


# --- jobs -----------------------------------------------------------------------------------------


def _tokens(block: w.Block):
    low = block.lowered()
    found = w.spans(low, w.NOT_BLANK)
    return low.data, found, w.span_hashes(low.data, found.starts, found.ends)


def word_counts(docs: DataFrame) -> DataFrame:
    """(wh, word, c) of every word of (text, taught); c counts training documents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taught = np.asarray(batch.column("taught"))
            for block in w.blocks(batch.column("text"), 8 << 20):
                hashes, training, data, starts, ends, base = [], [], [], [], [], 0
                # hashes are taken over small parts, distinct words over the whole block
                for part in w.blocks(batch.column("text").slice(block.first, block.rows)):
                    bytes_, found, h = _tokens(part)
                    hashes.append(h)
                    training.append(taught[block.first + part.first + found.rows])
                    starts.append(found.starts + base)
                    ends.append(found.ends + base)
                    data.append(bytes_)
                    base += len(bytes_)
                h = np.concatenate(hashes)
                unique, first, at = np.unique(h, return_index=True, return_inverse=True)
                counts = np.bincount(at, np.concatenate(training), minlength=len(unique)).astype(np.int64)
                words = w.span_strings(np.concatenate(data), np.concatenate(starts)[first], np.concatenate(ends)[first])
                for a in range(0, len(unique), CHUNK_WORDS):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(unique[a : a + CHUNK_WORDS].view(np.int64)),
                            words.slice(a, CHUNK_WORDS).cast(pa.string()), pa.array(counts[a : a + CHUNK_WORDS]),
                        ],
                        ["wh", "word", "c"],
                    )

    counted = docs.select("text", "taught").mapInArrow(run, "wh bigint, word string, c bigint")
    return counted.groupBy("wh", "word").agg(F.sum("c").alias("c"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_WORDS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _word_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    texts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    return np.frombuffer(texts.buffers()[2], np.uint8), offsets


def expected_uses(words: DataFrame, lattice: Lattice) -> np.ndarray:
    """Expected uses of every piece over counted words (word, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(len(lattice.log))
        for table in _chunks(batches):
            data, offsets = _word_bytes(table.column("word"))
            uses += lattice.run(data, offsets, np.asarray(table.column("c"), np.float64))[1]
        at = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses[at])], ["piece", "uses"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(run, "piece bigint, uses double")
    out = np.zeros(len(lattice.log))
    for r in rows.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # at most one per piece
        out[r["piece"]] = r["uses"]
    return out


def word_scores(words: DataFrame, lattice: Lattice) -> DataFrame:
    """(wh, c, lp): natural log probability of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            data, offsets = _word_bytes(table.column("word"))
            score, _ = lattice.run(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [table.column("wh").combine_chunks(), table.column("c").combine_chunks(), pa.array(score)], ["wh", "c", "lp"]
            )

    return words.select("wh", "word", "c").mapInArrow(run, "wh bigint, c bigint, lp double")


def split_documents(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], size: float) -> DataFrame:
    """(doc_id, held_out, n_tokens, f_known, f_base, f_lp, rare): sums over frequent words, other words listed.

    `frequent`: sorted hashes, counts, log probabilities; a word's base is log10((c + 0.5) / size).
    """
    hashes, counts, lps = frequent
    seen = np.zeros(1 << 22, bool)
    seen[hashes & np.uint64((1 << 22) - 1)] = True
    base = np.log10((counts + 0.5) / size)
    known = (counts > 0).astype(np.float64)
    sent = docs.sparkSession.sparkContext.broadcast((hashes, base, lps, known, seen))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, base, lps, known, seen = sent.value
        for batch in batches:
            for block in w.blocks(batch.column("text")):
                _, found, h = _tokens(block)
                n = block.rows
                maybe = np.flatnonzero(seen[h & np.uint64((1 << 22) - 1)]) if len(hashes) else np.empty(0, np.int64)
                at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                hit = hashes[at] == h[maybe] if len(maybe) else np.empty(0, bool)
                at, rows = at[hit], found.rows[maybe[hit]]
                other = np.ones(len(h), bool)
                other[maybe[hit]] = False
                rare_rows, rare = found.rows[other], h[other]
                order = np.lexsort((rare, rare_rows))
                rare_rows, rare = rare_rows[order], rare[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]) | (rare_rows[1:] != rare_rows[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(rare)))
                ends = np.zeros(n + 1, np.int32)
                np.cumsum(np.bincount(rare_rows[starts], minlength=n), out=ends[1:])
                pairs = pa.StructArray.from_arrays(
                    [pa.array(rare[starts].view(np.int64)), pa.array(times.astype(np.int32))], ["wh", "n"]
                )
                own = batch.slice(block.first, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id"), own.column("held_out"), pa.array(found.counts.astype(np.int64)),
                        *[pa.array(np.bincount(rows, v[at], minlength=n).astype(np.float64)) for v in (known, base, lps)],
                        pa.ListArray.from_arrays(pa.array(ends), pairs),
                    ],
                    ["doc_id", "held_out", "n_words", "f_known", "f_base", "f_lp", "rare"],
                )

    schema = (
        f"doc_id {id_type}, held_out boolean, n_words bigint, f_known double, f_base double, f_lp double, "
        "rare array<struct<wh: bigint, n: int>>"
    )
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def score(docs: DataFrame, vocabulary: str, held_out: Column, rounds: int = EM_ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, text)."""
    marked = docs.select("doc_id", "text", held_out.alias("held_out")).withColumn("taught", ~F.col("held_out"))
    words = materialize(word_counts(marked), "lm-words")
    ends = marked.where("taught").count()
    facts = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    tokens = int(facts["n"] or 0) + ends
    size = tokens + 0.5 * (int(facts["v"]) + (ends > 0) + 1)

    pieces, weights = vocabulary_pieces(vocabulary)
    lattice = Lattice(pieces, weights)
    # the end is one more outcome; without training documents it is as likely as the rarest piece
    end = float(weights.min())
    if tokens:
        for _ in range(rounds):
            uses = expected_uses(words, lattice) + PRIOR
            end = ends / (uses.sum() + ends)
            lattice = lattice.with_weights(uses / (uses.sum() + ends))
    scored = materialize(word_scores(words, lattice), "lm-scores")
    top = scored.where(F.col("c") * FREQUENT > tokens).orderBy("wh").toPandas()  # at most FREQUENT words
    hashes = top["wh"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    frequent = (hashes[order], top["c"].to_numpy(np.int64)[order], top["lp"].to_numpy(np.float64)[order])

    split = split_documents(marked, frequent, size).withColumn("rid", F.monotonically_increasing_id())
    split = materialize(split, "lm-documents")
    rest = scored.where(F.col("c") * FREQUENT <= tokens).select(
        "wh", (F.col("c") > 0).alias("known"), F.log10((F.col("c") + 0.5) / size).alias("base"), "lp"
    )
    by_doc = (
        split.select("rid", F.inline("rare")).join(rest, "wh")
        .select("rid", F.when(F.col("known"), F.col("n")).otherwise(0).alias("k"), (F.col("n") * F.col("base")).alias("b"), (F.col("n") * F.col("lp")).alias("l"))
        .groupBy("rid").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("l").alias("l"))
    )
    end_base = float(np.log10((ends + 0.5) / size))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return split.join(by_doc, "rid", "left").select(
        "doc_id", "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("f_known").cast("bigint") + zero("k") + int(ends > 0)).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("f_base") + zero("b") + end_base).alias("base_score"),
        ((F.col("f_lp") + zero("l") + float(np.log(end))) / float(np.log(10))).alias("score"),
    )
