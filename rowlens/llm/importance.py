"""Importance resampling towards a target: hashed n-gram features, log-ratio gains, Gumbel top-k.

A 256-byte table lower-cases A-Z and blanks every separator of a UTF-8 text, `bytes.split` gives
its words, and a word's crc32 seeds the crc32 of the n-gram that it begins: crc32(b" " + next, seed)
is the checksum of the longer feature, so no n-gram is ever built as a string. A Counter per Arrow
batch reduces the features to at most `buckets` rows before the shuffle, whatever the batch holds.

A bucket's gain is the log ratio of its smoothed shares in target and corpus. A row's weight is the
sum of the gains of its features, and adding Gumbel noise, which is drawn from a hash of the id,
makes the highest scores a sample without replacement in proportion to the exponentials of the
weights. The order over all rows comes from range partitions, never from one task.

Defined cases: a null text has no words; an empty corpus or target has smoothed shares only; a
null id is hashed as the empty text; rows that repeat an id and a text get the same score and
neighbouring ranks; ties go to the smaller id, null ids first; columns of any name are kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rowlens.llm.rows import packed, unpacked
from rowlens.llm.ship import by_value
from rowlens.sources.scratch import materialize

by_value(__name__)

BUCKETS, LONGEST = 10_000, 3
SEED, PERCENT, MIN_WORDS = 42, 5, 20
GAIN_SCALE = 1000
PIECE_BYTES = 1 << 18
_BLANK = 0x20


def _table() -> bytes:
    """Lower-cases A-Z; digits, a-z and all bytes outside ASCII stay, the rest becomes a blank."""
    out = bytearray([_BLANK]) * 256
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            out[b] = b
        elif 0x41 <= b <= 0x5A:
            out[b] = b + 32
    return bytes(out)


TABLE = _table()


def _pieces(data: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text in pieces that end at a blank, so that a long one never becomes one list of words."""
    begin = 0
    while begin < len(data):
        end = begin + limit
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[begin:end]
        begin = end


def checksums(text: bytes, longest: int = LONGEST) -> Iterator[tuple[int, list[int]]]:
    """Per piece of a text its number of words and the crc32 of every n-gram that ends in it."""
    before: list[bytes] = []  # the last words of the piece before
    for piece in _pieces(text.translate(TABLE)):
        new = piece.split()
        words = before + new
        spaced = [b" " + x for x in words[1:]]
        grams = list(map(crc32, words))
        out = grams[len(before) :]
        for n in range(1, longest):
            grams = list(map(crc32, spaced[n - 1 :], grams))
            out += grams[max(0, len(before) - n) :]
        yield len(new), out
        before = words[len(words) - min(longest - 1, len(words)) :]


def _bytes(texts: pa.Array) -> Iterator[bytes]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for x in texts:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of all features of the column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[int] = Counter()
            for text in _bytes(batch.column(0)):
                for _, sums in checksums(text, longest):
                    found.update(map(int.__mod__, sums, repeat(buckets)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["bucket", "n"]
            )

    parts = texts.select("text").mapInArrow(run, "bucket int, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> list[int]:
    """At most `buckets` rows come to the driver."""
    out = [0] * buckets
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """One whole number per bucket: how much likelier the target is to hold its features, in thousandths."""
    s, t = (_dense(bucket_counts(rows, buckets, longest), buckets) for rows in (corpus, target))
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(GAIN_SCALE * math.log((y + 1.0) * all_s / ((x + 1.0) * all_t))) for x, y in zip(s, t, strict=True)]


def weighed(text: Column, gain: list[int], longest: int = LONGEST) -> Column:
    """Struct (n_words, n_features, weight) of a text column."""
    buckets = len(gain)

    def weigh(texts: pa.Array) -> pa.Array:
        rows = []
        for x in _bytes(texts):
            n_words = n_features = weight = 0
            for words, sums in checksums(x, longest):
                n_words += words
                n_features += len(sums)
                weight += sum(map(gain.__getitem__, map(int.__mod__, sums, repeat(buckets))))
            rows.append((n_words, n_features, weight))
        table = np.array(rows, np.int64).reshape(len(rows), 3)
        names = ["n_words", "n_features", "weight"]
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], names)

    return arrow_udf(weigh, "struct<n_words: bigint, n_features: bigint, weight: bigint>")(text)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    share = (h.cast("double") + 0.5) / F.lit(float(1 << 32))
    return F.floor(-GAIN_SCALE * F.log(-F.log(share)))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """`docs` (doc_id, text, ...) with the struct `_importance` (n_words, n_features, weight, score)."""
    own = weighed(F.col("text"), gains(docs, target))
    found = docs.withColumn("_importance", own)
    return found.withColumn("_importance", F.col("_importance").withField("score", F.col("_importance.weight") + noise(F.col("doc_id"), seed)))


def ranked(rows: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """`rows` (doc_id, n_words, score, ...) with `rank`: 1, 2, ... for the highest `percent` of the
    rows with `min_words` words or more; null for all others."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    large = rows.where(F.col("n_words") >= min_words).repartitionByRange(*order).sortWithinPartitions(*order)
    # the place in the order is written with the row: a part's number and the row's number in the part
    large = materialize(large.withColumn("_at", F.monotonically_increasing_id()), "importance-order")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = large.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row per range
    wanted = sum(r["n"] for r in sizes) * percent // 100
    before, starts = 0, []
    for r in sizes:
        if before < wanted:
            starts.append((r["part"], before))
        before += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "_part bigint, _before bigint"))
    placed = large.withColumn("_part", part).join(offsets, "_part", "left")
    rank = F.col("_before") + place + 1
    done = placed.withColumn("rank", F.when(rank <= wanted, rank)).drop("_part", "_before", "_at")
    small = rows.where(F.coalesce(F.col("n_words"), F.lit(0)) < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return done.unionByName(small)


def importance(docs: DataFrame, target: DataFrame, seed: int = SEED, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), a row per row of `docs`."""
    found = scored(docs.select("doc_id", "text"), target.select("text"), seed).select("doc_id", "_importance.*")
    return ranked(materialize(found, "importance-scores"), percent=percent)


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that are drawn, with all their columns.

    Texts are not moved: the last drawn score and id decide. Rows equal to the last one in both
    are all kept or all left, whichever the exact number allows for the first of them.
    """
    kept = packed(docs, "doc_id", "text")
    rows = materialize(scored(kept, target.select("text"), seed), "importance-rows")
    order = ranked(rows.select("doc_id", "_importance.n_words", "_importance.score"), percent=percent)
    last = order.where("rank IS NOT NULL").orderBy(F.desc("rank")).limit(1).collect()
    if not last:
        return docs.limit(0)
    score, doc_id = last[0]["score"], F.lit(last[0]["doc_id"])
    found = F.col("_importance.score")
    before = F.coalesce(F.col("doc_id") <= doc_id, F.col("doc_id").isNull())
    drawn = (F.col("_importance.n_words") >= MIN_WORDS) & ((found > score) | ((found == score) & before))
    return unpacked(rows.where(drawn), docs)
