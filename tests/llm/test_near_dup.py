"""Near-duplicate groups against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlens.llm import near_dup
from rowlens.llm.components import components

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, size):
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(docs, size, percent):
    sets = [shingles(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc_id)
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(d, len(sets[i]), ids[find(i)]) for i, (d, _) in enumerate(docs)]


def drifting(seed, copies, edits):
    """Copies of one text with a growing number of changed words: some link, most do not."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
    out = []
    for i in range(copies):
        words = list(base)
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 100000)}"
        out.append((i * 3 + 1, " ".join(words)))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_brute_force(spark, size):
    docs = drifting(1, 150, 25) + [
        (2, None), (4, ""), (5, " \n\t"), (8, "One"), (9, "one"), (11, "one two"), (12, "ONE\tTwo"), (14, "two one"),
        (1, docs_text := "a b c d e f g h"), (1, docs_text), (1, "z y x w v u"), (None, docs_text + " i"), (None, "lonely words stay here now"),
        (20, "p " * 5000), (21, "p p p"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = near_dup.groups(df, size=size, percent=80)
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(brute(docs, size, 80), key=repr)


def test_prefix_filter_finds_every_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "_second_hubs", lambda open_, comps, percent: (open_.select(F.col("cls").alias("a"), F.col("cls").alias("b")).where("false"), open_))
    docs = drifting(7, 200, 30)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.groups(df, size=2, percent=80).collect()]
    assert sorted(rows) == sorted(brute(docs, 2, 80))


@pytest.mark.parametrize("way", ["hubs", "prefix"])
def test_groups_without_broadcasts(spark, monkeypatch, way):
    monkeypatch.setattr(near_dup, "BROADCAST_BYTES", 0)  # as on large input
    if way == "prefix":
        monkeypatch.setattr(near_dup, "_second_hubs", lambda open_, comps, percent: (open_.select(F.col("cls").alias("a"), F.col("cls").alias("b")).where("false"), open_))
    docs = drifting(7, 200, 30)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.groups(df, size=2, percent=80).collect()]
    assert sorted(rows) == sorted(brute(docs, 2, 80))


@pytest.mark.parametrize("keys", [1000, 0])
def test_later_rounds_deal_asked_sets_only(spark, monkeypatch, keys):
    monkeypatch.setattr(near_dup, "BROADCAST_BYTES", 0)
    docs = drifting(3, 150, 25) + [(1000 + 2 * i + j, " ".join(f"q{i}x{k}" for k in range(30)) + " end" * j) for i in range(100) for j in (0, 1)]
    counts, write = {}, near_dup.materialize

    def noted(df, label):
        out = write(df, label)
        counts.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(near_dup, "materialize", noted)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(near_dup, "BROADCAST_KEYS", keys)
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.groups(df, size=2, percent=80).collect()]
    assert sorted(rows) == sorted(brute(docs, 2, 80))
    assert counts["near-asked"] and all(n <= counts["near-sets"][0] - 200 for n in counts["near-asked"])


def test_registers_of_chunks(monkeypatch):
    rnd = np.random.default_rng(1)
    sizes = [0, 1, 5, 300, 0, 4000]
    elements = rnd.integers(0, 1 << 63, sum(sizes), dtype=np.uint64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    whole = near_dup.super_minhash(elements, first)
    monkeypatch.setattr(near_dup, "_CHUNK", 37)
    in_chunks = near_dup.super_minhash(elements, first)
    assert (whole == in_chunks)[np.array(sizes) > 0].all()


def test_keep_one(spark):
    docs = [(3, "a b c d e f g", 1), (1, "a b c d e f g", 2), (1, "a b c d e f g", 2), (None, "a b c d e f g", 3), (7, None, 4), (8, "", 5), (8, "", 5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, kid int").withColumn("group", F.lit("g"))
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.kid for r in kept.collect()) == [2, 4, 5, 5]


def test_empty_table(spark):
    assert near_dup.groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 99), (101, 100), (99, 101), (7, 7)] + [(1000 + i, 1000) for i in range(50)]
    got = {r.u: r.v for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 99, 101: 99} | {1000 + i: 1000 for i in range(1, 50)}


@pytest.mark.parametrize("links", [0, 100_000])
def test_components_end_with_stars(spark, monkeypatch, links):
    """No round more is run to see that nothing changes, and stars need none at all."""
    from rowlens.llm import components as module

    written = []
    monkeypatch.setattr(module, "BROADCAST_LINKS", links)
    monkeypatch.setattr(module, "materialize", lambda df, label, f=module.materialize: (written.append(label), f(df, label))[1])

    def found(edges):
        written.clear()
        return sorted(tuple(r) for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())

    assert found([(0, i) for i in range(1, 30)] + [(50, 51), (51, 50), (7, 7)]) == [*((i, 0) for i in range(1, 30)), (51, 50)]
    assert len(written) == 1
    # the larger neighbour of two is joined to both: one round makes the star
    assert found([(9, 1), (9, 5)]) == [(5, 1), (9, 1)]
    assert len(written) == 2
    assert found([]) == []
    assert found([(i, i + 1) for i in range(40)]) == [(i, 0) for i in range(1, 41)]


def test_prefix_filter_joins_few_pairs_of_a_drifted_group(spark, monkeypatch):
    """Texts that only share the frequent half of their shingles are not paired, links are."""
    sets = []
    for c in range(1, 61):
        shingles = {*range(10_000, 10_060), *((c * 7 + j * j * 13) % 40 for j in range(40))}
        sets.append((c, near_dup.w.mix(np.array(sorted(shingles), np.uint64)).view(np.int64).tolist()))
    df = spark.createDataFrame(sets, "cls bigint, elements array<bigint>")
    unclear = spark.createDataFrame([(c, len(s), c) for c, s in sets], "cls bigint, n bigint, comp bigint")
    pairs = {(r.a, r.b) for r in near_dup._prefix_pairs(unclear, df, 90).collect()}
    links = {
        (a, b) for a, x in sets for b, y in sets
        if a < b and 100 * len(set(x) & set(y)) >= 90 * len(set(x) | set(y))
    }
    monkeypatch.setattr(near_dup.F, "bit_count", lambda column: near_dup.F.lit(0))
    loose = near_dup._prefix_pairs(unclear, df, 90).count()
    assert links and links <= pairs and 2 * len(pairs) < loose
