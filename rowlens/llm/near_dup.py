"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and components.

SuperMinHash gives each shingle one random permutation of the registers: in round j the shingle
offers `j + r` to the next register of its permutation, so ranks of one shingle are spread over
the registers and the estimate varies less than with independent hashes. A document stops after
the first round in which every register holds a value of that round or an earlier one.

Documents with equal shingle sets are one class. Classes meet in band buckets. In a bucket hubs
are compared with the members that are not yet known to be connected to them, links join
components, and the bucket is finished when its members that were not hubs yet belong to one
component: every pair of a bucket is then verified or known to be connected. A group of thousands
of near copies thus costs about one comparison per member. Classes of buckets that are not
finished after two rounds, such as a large group of copies that drifted apart, are compared by an
exact prefix filter instead. Every pair that is compared is compared by its full sets of 64-bit
shingles, at any size of the input. With 36 bands of 6 registers, a pair of similarity 0.8 meets
in some bucket except with probability 2e-5.

Defined cases: null or blank texts have no shingles and are linked with nothing; rows may repeat
ids and texts; a row without id belongs to the smallest id of its group, if there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm import words as w
from rowlens.llm.components import components
from rowlens.llm.ship import by_value
from rowlens.sources.scratch import materialize

by_value(__name__)

BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
SHINGLE, PERCENT = 5, 80
HUBS = 1  # per bucket in the second round
BITMAP_WORDS = 8  # of 64 bits, for a class that is compared by the prefix filter
BROADCAST_BYTES = 16 << 20
BROADCAST_KEYS = 2_000_000  # 8 bytes each
_BLOCK = 1 << 17  # bytes of text whose shingles are in a worker's memory at once
_CHUNK = 1 << 14  # shingles of one set that are offered to the registers at once


def shingle_sets(block: w.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and where each text's begin (with the end)."""
    low = block.lowered()
    found = w.spans(low, w.NOT_BLANK)
    hashes = w.span_hashes(low.data, found.starts, found.ends)
    begin = w.windows(found, size)
    values, rows = [w.gram_hashes(hashes, size)[begin]], [found.rows[begin]]
    counts = found.counts
    for short in range(1, size):  # fewer words than a shingle: the whole text is one
        own = np.flatnonzero(counts == short)
        if len(own):
            values.append(w.mix(w.gram_hashes(hashes, short)[found.first[own]] + np.uint64(short)))
            rows.append(own)
    values, rows = np.concatenate(values), np.concatenate(rows).astype(np.uint16)
    order = np.argsort(values)
    order = order[np.argsort(rows[order], kind="stable")]  # by text, then by shingle
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(block.rows + 1))


def super_minhash(elements: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """One row of `registers` values per set: round number in the high bits, random rank below.

    A large set is offered in chunks, as the registers of a union are the least of its parts'.
    """
    parts = np.maximum(1, -(-np.diff(first) // _CHUNK))
    if (parts == 1).all():
        return _registers(elements, first, registers)
    begin = np.concatenate([np.arange(a, max(b, a + 1), _CHUNK) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
    table = _registers(elements, np.append(begin, first[-1]), registers)
    return np.minimum.reduceat(table, np.cumsum(parts) - parts, axis=0)


def _registers(elements: np.ndarray, first: np.ndarray, registers: int) -> np.ndarray:
    n = len(first) - 1
    table = np.full(n * registers, np.iinfo(np.uint64).max, np.uint64)
    rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(first))
    live = elements
    order = None
    for j in range(registers):
        if not len(live):
            break
        with np.errstate(over="ignore"):
            seed = w.mix(live + np.uint64(j) * np.uint64(0x9E3779B97F4A7C15))
        left = registers - j
        swap = j + ((seed >> np.uint64(40)) * np.uint64(left) >> np.uint64(24)).astype(np.int64)
        if j == 0:
            target = swap
        else:
            if order is None:
                # round 0 swapped place 0 with the place drawn there
                order = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.uint16), (len(live), 1))
                at = np.arange(len(live))
                zero = ((w.mix(live) >> np.uint64(40)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64)
                order[at, zero] = 0
                order[at, 0] = zero
            at = np.arange(len(live))
            target = order[at, swap].astype(np.int64)
            order[at, swap] = order[at, j]
        rank = (np.uint64(j) << np.uint64(48)) | (w.mix(seed) >> np.uint64(16))
        np.minimum.at(table, rows * registers + target, rank)
        full = table.reshape(n, registers).max(axis=1) < (np.uint64(j + 1) << np.uint64(48))
        keep = ~full[rows]
        if not keep.all():
            live, rows = live[keep], rows[keep]
            order = None if order is None else order[keep]
    return table.reshape(n, registers)


def set_digest(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order-free 64-bit digest of each set and its size."""
    running = np.zeros(len(elements) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(w.mix(elements + np.uint64(12345)), out=running[1:])
        return w.mix(running[first[1:]] - running[first[:-1]] + np.diff(first).astype(np.uint64))


def _small_blocks(texts) -> Iterator[w.Block]:
    """Blocks of fewer than 65,536 texts."""
    for begin in range(0, len(texts), 60_000):
        yield from w.blocks(texts.slice(begin, 60_000), _BLOCK)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, cls, bands) of rows (doc_id, text_key, text); bands are empty
    without shingles."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for block in _small_blocks(batch.column("text")):
                elements, first = shingle_sets(block, size)
                table = super_minhash(elements, first)
                bands = np.empty((block.rows, BANDS), np.uint64)
                for b in range(BANDS):
                    with np.errstate(over="ignore"):
                        key = np.full(block.rows, b + 1, np.uint64)
                        for c in table[:, b * ROWS : (b + 1) * ROWS].T:
                            key = w.mix(key * np.uint64(0x9E3779B97F4A7C15) + c)
                    bands[:, b] = key
                sizes = np.diff(first)
                ends = np.zeros(block.rows + 1, np.int32)
                np.cumsum(np.where(sizes > 0, BANDS, 0), out=ends[1:])
                own = batch.slice(begin, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id"), own.column("text_key"), pa.array(sizes.astype(np.int64)),
                        _signed(set_digest(elements, first)),
                        pa.ListArray.from_arrays(pa.array(ends), _signed(bands[sizes > 0].ravel())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "cls", "bands"],
                )
                begin += block.rows

    return docs.select("doc_id", "text_key", "text").mapInArrow(
        run, f"doc_id {id_type}, text_key bigint, n_shingles bigint, cls bigint, bands array<bigint>"
    )


def class_sets(texts: DataFrame, size: int) -> DataFrame:
    """(cls, elements) of texts: the shingles of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _small_blocks(batch.column("text")):
                elements, first = shingle_sets(block, size)
                sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), _signed(elements))
                yield pa.RecordBatch.from_arrays([_signed(set_digest(elements, first)), sets], ["cls", "elements"])

    return texts.select("text").mapInArrow(run, "cls bigint, elements array<bigint>")


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs (a, b, ea, eb) whose sets overlap enough."""
    common = F.size(F.array_intersect("ea", "eb"))
    every = (F.size("ea") + F.size("eb") - F.col("common")).cast("bigint")
    return pairs.withColumn("common", common).where(100 * F.col("common").cast("bigint") >= percent * every).select("a", "b")


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast a written table up to `BROADCAST_BYTES`; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _pair(left: str, right: str) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _second_hubs(open_: DataFrame, comps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of up to `HUBS` members per bucket, outside its main component, with the other
    members of the bucket; and (key, cls, n, hub) of what was open, `hub` telling who was one."""
    labelled = open_.join(_small(comps, 16), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    per_comp = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n_members"))
    main = (
        per_comp.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_comps"), F.max(F.struct("n_members", "comp")).alias("m"))
        .where("n_comps > 1")
        .select("key", F.col("m.comp").alias("main"))
    )
    main = _small(materialize(main, "near-main"), 16)  # a bucket of thousands is dealt by its key only where this is large
    rest = materialize(labelled.join(main, "key"), "near-open")
    salt = F.pmod(F.xxhash64("cls"), F.lit(HUBS))
    hubs = rest.where("comp <> main").groupBy("key", salt.alias("salt")).agg(F.min(F.struct("cls", "n", "comp")).alias("hub"))
    hubs = materialize(hubs.select("key", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.comp").alias("hub_comp")), "near-hubs")
    hubs = _small(hubs, 32)
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pairs = rest.join(hubs, "key").where((F.col("comp") != F.col("hub_comp")) & fits).select(*_pair("cls", "hub")).distinct()
    left = rest.join(hubs.select("key", F.col("hub").alias("cls")), ["key", "cls"], "left_anti").select("key", "cls", "n")
    return pairs, left


def classes_linked(classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): class u belongs to the component of class v; classes alone are left out.

    `classes`: (cls, n, text_key, bands), one row each; `texts`: (text_key, text).
    """
    members = classes.select("cls", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("cls", "n")).alias("hub")).where("size > 1")
    members = materialize(members.join(buckets, "key"), "near-members")
    met = materialize(members.select("cls").distinct(), "near-met")
    about = materialize(classes.select("cls", "text_key").join(_small(met, 8), "cls"), "near-about")
    wanted = texts.join(_small(about.select("text_key"), 8), "text_key", "left_semi").dropDuplicates(["text_key"])
    sets = materialize(class_sets(wanted, size).dropDuplicates(["cls"]), "near-sets")
    weight = sets.agg(F.sum(F.size("elements").cast("bigint"))).first()[0] or 0
    shown = F.broadcast(sets) if 8 * weight <= BROADCAST_BYTES else sets
    spark = classes.sparkSession
    state = _State(spark.createDataFrame([], "u bigint, v bigint"), spark.createDataFrame([], "cls bigint, comp bigint"))

    def verify(pairs: DataFrame, few: bool = True) -> None:
        """Links the pairs that overlap enough, and joins their components; where `few` classes are
        in the pairs, the sets of the others are not dealt."""
        asked = shown
        if few and shown is sets:
            pairs = materialize(pairs, "near-pairs")
            ids = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
            ids = materialize(ids, "near-asked")
            asked = sets.join(F.broadcast(ids), "cls", "left_semi") if ids.count() <= BROADCAST_KEYS else sets
        linked = _linked(pairs.join(asked.toDF("a", "ea"), "a").join(asked.toDF("b", "eb"), "b"), percent)
        linked = materialize(linked, "near-links")
        if not linked.isEmpty():
            state.join(linked)

    fits = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    verify(members.where((F.col("cls") != F.col("hub.cls")) & fits).select(*_pair("cls", "hub.cls")).distinct(), few=False)
    # a bucket of two is settled; in others the members that were not the hub are left
    open_ = members.where((F.col("size") > 2) & (F.col("cls") != F.col("hub.cls"))).select("key", "cls", "n")
    pairs, open_ = _second_hubs(open_, state.comps, percent)
    verify(pairs)
    unclear = materialize(_unclear(open_, state.comps), "near-unclear")
    if not unclear.isEmpty():
        verify(_prefix_pairs(unclear, sets, percent))
    return state.edges


class _State:
    """Components as (node, smallest node), and as (cls, comp) of all nodes in one."""

    def __init__(self, edges: DataFrame, comps: DataFrame):
        self.edges, self.comps = edges, comps

    def join(self, linked: DataFrame) -> None:
        self.edges = components(self.edges.unionByName(linked.select(F.col("b").alias("u"), F.col("a").alias("v"))))
        roots = self.edges.select(F.col("v").alias("cls")).distinct().withColumn("comp", F.col("cls"))
        self.comps = materialize(self.edges.select(F.col("u").alias("cls"), F.col("v").alias("comp")).unionByName(roots), "near-comps")


def _unclear(open_: DataFrame, comps: DataFrame) -> DataFrame:
    """(cls, n, comp) of classes in buckets whose members that were not hubs lie in several components."""
    labelled = open_.join(_small(comps, 16), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    return labelled.join(mixed, "key").select("cls", "n", "comp").distinct()


def _exploded(sets: DataFrame) -> DataFrame:
    """(cls, token) of class sets."""

    return sets.select("cls", F.explode("elements").alias("token"))


def _prefix_pairs(unclear: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of unclear classes of different components that can overlap enough.

    With shingles ordered from rare to frequent, the first common shingle of two sets at places i
    and j leaves an overlap of at most min(n - i, m - j), which must reach p / (100 + p) of n + m.
    So it lies in the first (100 - p) / 100 of both sets and in the first (100 - p) / (100 + p) of
    one. Members of a group that differ in many places begin with shingles no one else has.

    A pair that meets must also pass by its bitmaps: each shingle flips one bit, so two bitmaps differ
    in no more bits than the sets have shingles that only one of them holds, which are at most
    (100 - p) / (100 + p) of n + m. Copies that share frequent shingles only seldom pass.
    """
    who = _small(unclear, 32)
    tokens = materialize(_exploded(sets.join(who.select("cls"), "cls")), "near-tokens")
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("frequency"))
    place = F.row_number().over(Window.partitionBy("cls").orderBy("frequency", "token")) - 1
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(token, 32) & 63 as int))")
    word = F.pmod("token", F.lit(BITMAP_WORDS))
    bitmap = [F.bit_xor(F.when(word == k, bit).otherwise(0)).over(Window.partitionBy("cls")) for k in range(BITMAP_WORDS)]
    entries = (
        tokens.join(frequency, "token").withColumns({"i": place} | {f"b{k}": x for k, x in enumerate(bitmap)})
        .where("frequency > 1").join(who, "cls")
        .where(100 * F.col("i") <= (100 - percent) * F.col("n"))
        .select("token", "cls", "n", "comp", "i", *[f"b{k}" for k in range(BITMAP_WORDS)])
    )
    entries = materialize(entries, "near-entries")
    early = entries.where((100 + percent) * F.col("i") <= (100 - percent) * F.col("n"))
    other = entries.toDF("token", "cls2", "n2", "comp2", "i2", *[f"c{k}" for k in range(BITMAP_WORDS)])
    reach = F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) * (100 + percent) >= percent * (F.col("n") + F.col("n2"))
    apart = sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"c{k}"))) for k in range(1, BITMAP_WORDS)), F.bit_count(F.col("b0").bitwiseXOR(F.col("c0"))))
    near = (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n2"))
    joined = early.join(other, (early["token"] == other["token"]) & (F.col("comp") != F.col("comp2")) & reach & near)
    return joined.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()


def groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, group, component_id), a row per row of `docs` (doc_id, text).

    `group` is null without shingles. Every group has its own number, also where ids are null.
    """
    keyed = with_key(docs.select("doc_id", "text"))
    signed = materialize(signatures(keyed, size), "near-signatures")
    classes = materialize(
        signed.where("n_shingles > 0")
        .groupBy("cls")
        .agg(
            F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("text_key").alias("text_key"),
            F.first("bands").alias("bands"),
        ),
        "near-classes",
    )
    edges = classes_linked(classes, keyed.select("text_key", "text"), size, percent)
    root = classes.select("cls", "low").join(edges.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left")
    root = root.withColumn("root", F.coalesce("root", "cls"))
    lowest = root.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = root.join(lowest, "root").select("cls", F.col("root").alias("group"), "component_id")
    found = signed.select("doc_id", "text_key", "n_shingles", "cls").join(by_class, "cls", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_key", "n_shingles", "group", own.alias("component_id"))


def with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each group: the smallest id, null ids last. Texts without words stay."""
    found = materialize(groups(docs.select("doc_id", "text"), size, percent), "near-groups")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    grouped = found.where("group IS NOT NULL")
    best = grouped.groupBy("group").agg(F.min(row).alias("best"))
    lost = (
        grouped.join(best, "group").where(row != F.col("best"))
        .select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    )
    lost = materialize(lost, "near-lost")
    if lost.count() <= BROADCAST_KEYS:
        lost = F.broadcast(lost)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    kept = docs.join(lost, (key == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti")
    # rows that repeat id and text of a row that stays
    again = grouped.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialize(again.select("doc_id", "text_key"), "near-again")
    if again.isEmpty():
        return kept
    same = again.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
    matches = (key == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    once = kept.join(same, matches, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(same, matches, "left_anti").unionByName(once)
