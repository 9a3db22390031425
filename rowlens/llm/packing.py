"""Token packing along a space-filling curve.

A document's bag of words is projected to a few dimensions by random signs, the point is numbered
along a Hilbert curve, and documents are laid end to end in curve order and cut every `LENGTH`
tokens. Neighbours on the curve share vocabulary, so a sequence holds related documents, and only
the very last sequence is padded.

Texts are cut before white space that follows something else, where byte-level pre-tokenizers
never join; equal pieces are encoded once per Python worker, which keeps up to `Encoder.MOST` of
them from task to task. Token ids are written once, dealt to ranges of
the curve bounded by a quantile sketch (equal keys are spread by a hash of the row), and a range's
first position is the sum of the token counts before it: one number per range on the driver.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rowlens.llm import words as w
from rowlens.llm.ship import by_value
from rowlens.sources.scratch import scratch_path

by_value(__name__)

LENGTH, END_ID = 2048, 1
BLOCK_BYTES, TEXT_BYTES = 1 << 20, 1 << 17
DIMENSIONS, BITS = 4, 8
TIE_BITS = 20  # order keys stay below 2^52
_BLANK = ~w.NOT_BLANK


def _may_end_wide_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte before each place may end a blank outside ASCII (true too often is safe)."""
    one, two, three = (data[np.maximum(at - n, 0)] for n in (1, 2, 3))
    unsure = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    for lead, second in ((0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)):
        unsure |= (three == lead) & (two == second)
    return unsure & (one >= 0x80)


def cuts(block: w.Block) -> np.ndarray:
    """Starts of the pieces: text starts, and blanks that follow a character other than white space."""
    blank = _BLANK[block.data]
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    start = np.zeros(len(blank), bool)
    start[at[~_may_end_wide_blank(block.data, at)]] = True
    start[block.offsets[:-1][np.diff(block.offsets) > 0]] = True
    return np.flatnonzero(start)


class Encoder:
    """Token ids of many texts; equal pieces are encoded once.

    New pieces that begin with a blank and end with another character are encoded as one long text:
    no token crosses from one to the next, and the bytes of the tokens tell them apart again.
    Known pieces are a sorted array of hashes with the number of each, about 30 bytes a piece.
    """

    MOST = 1_000_000

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        # a token of a byte-level vocabulary has one character per byte
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self._clear()

    def _clear(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.number = np.empty(0, np.int32)
        self.first = np.zeros(1, np.int64)
        self.flat = np.empty(0, self.kind)

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has."""
        sure = _BLANK[data[starts]] & ~_BLANK[data[ends - 1]] & ~_may_end_wide_blank(data, ends)
        counts = np.zeros(len(starts), np.int64)
        taken, offsets = w.span_bytes(data, starts[sure], ends[sure])
        joined = np.empty(0, self.kind)
        if len(taken):
            whole, parts = taken.tobytes(), []
            at = 0  # the encoder needs a few hundred bytes of memory per byte of text
            while at < len(offsets) - 1:
                to = max(int(np.searchsorted(offsets, offsets[at] + TEXT_BYTES, "right")) - 1, at + 1)
                text = whole[offsets[at] : offsets[to]].decode("utf-8")
                parts.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind))
                at = to
            joined = np.concatenate(parts)
            counts[sure] = np.diff(np.searchsorted(np.cumsum(self.sizes[joined]), offsets, "right"))
        odd = np.flatnonzero(~sure)
        if not len(odd):
            return joined, counts
        texts = [data[a:b].tobytes().decode("utf-8") for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
        alone = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts[odd] = [len(x) for x in alone]
        out = np.empty(int(counts.sum()), self.kind)
        mine = np.repeat(~sure, counts)
        out[mine] = np.fromiter((x for one in alone for x in one), self.kind, int(mine.sum()))
        out[~mine] = joined
        return out, counts

    def encode(self, block: w.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each text and the end, hash and text of each piece)."""
        starts = cuts(block)
        ends = np.append(starts[1:], len(block.data)) if len(starts) else starts
        rows = np.searchsorted(block.offsets, starts, "right") - 1
        hashes = w.span_hashes(block.data, starts, ends)
        unique, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.MOST:
            self._clear()
        spot = np.searchsorted(self.known, unique)
        seen = spot < len(self.known)
        seen[seen] = self.known[spot[seen]] == unique[seen]
        number = np.empty(len(unique), np.int32)
        number[seen] = self.number[spot[seen]]
        new = np.flatnonzero(~seen)
        if len(new):
            ids, counts = self._ids(block.data, starts[at[new]], ends[at[new]])
            n = len(self.known)
            number[new] = np.arange(n, n + len(new))
            self.known = np.insert(self.known, spot[new], unique[new])
            self.number = np.insert(self.number, spot[new], number[new])
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(counts)))
            self.flat = np.concatenate((self.flat, ids))
        number = number[back]
        taken, offsets = w.span_bytes(self.flat, self.first[number], self.first[number + 1])
        piece = np.searchsorted(rows, np.arange(block.rows + 1))
        return taken, offsets[piece], hashes, rows


def curve_key(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Place on the Hilbert curve of each of n texts, from the pieces' hashes."""
    count = np.maximum(np.bincount(rows, minlength=n), 1)
    point = np.empty((n, DIMENSIONS), np.int64)
    for d in range(DIMENSIONS):
        sign = ((hashes >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(np.float64) * 2 - 1
        mean = np.bincount(rows, sign, minlength=n) / count
        point[:, d] = np.minimum((0.5 + 0.5 * np.tanh(4 * mean)) * (1 << BITS), (1 << BITS) - 1)
    return hilbert(point, BITS)


def hilbert(point: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve: axes are undone from the top bit down, then Gray-decoded."""
    x = point.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for d in range(dims):
            high = (x[d] & bit) > 0
            swapped = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swapped)
            if d:
                x[d] ^= swapped
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer_json: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, place, n_tokens, ids): `place` orders rows along the curve, ties by a hash of the row."""
    sent = docs.sparkSession.sparkContext.broadcast({"file": tokenizer_json})
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sent.value  # a worker's own copy, which its next task finds again
        encoder = kept.get("encoder") or kept.setdefault("encoder", Encoder(kept["file"]))
        for batch in batches:
            ties = np.asarray(batch.column("tie"))
            for block in w.blocks(batch.column("text"), BLOCK_BYTES):
                ids, first, hashes, rows = encoder.encode(block)
                n = block.rows
                sizes = np.diff(first) + 1
                ends = np.zeros(n + 1, np.int64)
                np.cumsum(sizes, out=ends[1:])
                out = np.full(ends[-1], end_id, encoder.kind)
                inner = np.ones(len(out), bool)
                inner[ends[1:] - 1] = False
                out[inner] = ids
                packed = pa.Array.from_buffers(
                    pa.large_binary(), n, [None, pa.py_buffer(ends * encoder.kind().itemsize), pa.py_buffer(out)]
                )
                place = (curve_key(hashes, rows, n) << TIE_BITS) | ties[block.first : block.first + n]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, n), pa.array(place), pa.array(sizes), packed.cast(pa.binary())],
                    ["doc_id", "place", "n_tokens", "ids"],
                )

    tie = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << TIE_BITS))
    rows = docs.select("doc_id", "text", tie.alias("tie"))
    return rows.mapInArrow(run, f"doc_id {id_type}, place bigint, n_tokens bigint, ids binary")


RANGE_BYTES = 64 << 20  # of ids in one range of the curve; the driver keeps one number per range


def pack(docs: DataFrame, tokenizer_json: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of `docs` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    path = scratch_path(spark, "packing-tokens")
    written = tokenized(docs, tokenizer_json, end_id)
    written.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(written.schema).parquet(path)

    # the driver does not load the vocabulary: a row, which has an id at least, tells the bytes of an id
    row = tokens.select("n_tokens", F.octet_length("ids").alias("bytes")).first()
    kind = np.uint16 if row is None or row["bytes"] == 2 * row["n_tokens"] else np.uint32
    written_bytes = (tokens.agg(F.sum("n_tokens")).first()[0] or 0) * kind().itemsize
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-written_bytes // RANGE_BYTES))
    shares = [i / n for i in range(1, n)] or [0.5]
    found = tokens.agg(F.percentile_approx("place", shares, 100 * n).alias("p")).first()["p"]
    bounds = np.unique(np.array(found or [], np.int64))

    def range_of(place: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, np.asarray(place), "left").astype(np.int32))

    ranged = tokens.withColumn("range", arrow_udf(range_of, "int")("place"))
    sums = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect()}
    begin = np.zeros(len(bounds) + 2, np.int64)
    np.cumsum([sums.get(i, 0) for i in range(len(bounds) + 1)], out=begin[1:])
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if position is None:
                position = int(begin[batch.column("range")[0].as_py()])
            sizes = np.asarray(batch.column("n_tokens"))
            at = position + np.concatenate(([0], np.cumsum(sizes)))
            position = int(at[-1])
            first, last = at[:-1] // length, (at[1:] - 1) // length
            n_pieces = last - first + 1
            row = np.repeat(np.arange(len(sizes)), n_pieces)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            sequence = first[row] + step
            start = np.maximum(sequence * length, at[row])
            end = np.minimum((sequence + 1) * length, at[row + 1])
            ids = [np.frombuffer(x.as_buffer(), kind).astype("<u4") for x in batch.column("ids")]
            inside, stop = start - at[row], end - at[row]
            crc = [zlib.crc32(ids[r][a:b]) for r, a, b in zip(row.tolist(), inside.tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)), pa.array(inside), pa.array(end - start),
                    pa.array(crc, pa.int64()), pa.array(sizes[row]), pa.array(sequence), pa.array(start - sequence * length),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    ordered = ranged.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("place", "doc_id")
    return ordered.select("doc_id", "n_tokens", "ids", "range").mapInArrow(
        cut,
        f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
