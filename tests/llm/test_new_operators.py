"""Spelling variants, toxicity and importance resampling on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowlens.llm import importance, queries, spelling, toxicity
from rowlens.llm import words as w

LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [
    None, "", " ", "\n\n", "A  b\tc\nA b c", "é ü  ñ　x ÀÉÿ×÷", "😀 Ångström Ōsaka", "x" * 30_000, "tic " * 9_000, "ab-cd_ef1gh\x00ij",
]


def table(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


# --- 11 ------------------------------------------------------------------------------------------


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {k: v for k, v in n.items() if len(k) >= 6 and v >= 5}


def brute_forms(n):
    near = {a: [b for b in n if one_apart(a, b)] for a in n}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= 5 * n[a] else None
    out = set()
    for a in n:
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, form[a], root, n[a], len(near[a]), n[form[a]] if form[a] else None))
    return out


def misspelled(seed, n):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(5, 9))) for _ in range(60)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 90)):
            x = base[min(int(rnd.expovariate(0.08)), 59)]
            while rnd.random() < 0.25:
                at = rnd.randrange(len(x))
                x = rnd.choice((x[:at] + x[at + 1 :], x[:at] + rnd.choice("abcé") + x[at:], x[:at] + rnd.choice("abcé") + x[at + 1 :]))
            words.append(x.upper() if rnd.random() < 0.1 and x.isascii() else x)
        out.append((i, rnd.choice((" ", ", ", "1", "\n")).join(words)))
    return out


@pytest.mark.parametrize(("shard_words", "cell_queries"), [(4096, 16384), (7, 5)])
def test_variants_equal_brute_force(spark, shard_words, cell_queries):
    docs = misspelled(1, 150) + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "nameless words here"), (7, "again again")] * 6
    got = {tuple(r) for r in spelling.variants(table(spark, docs), shard_words, cell_queries).collect()}
    want = brute_forms(brute_words(docs))
    assert got == want
    assert sum(r[1] is not None for r in want) >= 10


def test_index_finds_every_near_word():
    rnd = random.Random(4)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(6, 11))) for _ in range(500)} | {"a" * i for i in range(6, 90)}
    forward, back = sorted(words), sorted(x[::-1] for x in words)
    found = set()
    for known, reverse in ((forward, False), (back, True)):
        q, o = spelling.Index(known).near(known, spelling._halves(known, reverse))
        step = -1 if reverse else 1
        found |= {(known[a][::step], known[b][::step]) for a, b in zip(q, o, strict=True)}
    assert found == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_words_of_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(2).choice(["Straße", "words", "ÀÉ", "x1y", "longer-word"]) for _ in range(3000))
    whole = [x for part in spelling.text_words("7", np.frombuffer(text.encode(), np.uint8), 1, 3) for x in part]
    monkeypatch.setattr(spelling, "PIECE_BYTES", 50)
    assert whole == [x for part in spelling.text_words("7", np.frombuffer(text.encode(), np.uint8), 1, 3) for x in part]


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "short"), (3, "onlyonce")]):
        found = spelling.variants(table(spark, rows))
        assert found.collect() == [] and found.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_roots_follow_long_chains(spark):
    words = [("aaaaaa" + "b" * i, 2 * 5**i) for i in range(12)]
    near = spelling.near_words(spark.createDataFrame(words, "word string, n bigint"), 3, 4)
    roots = {r.word: r.root for r in spelling.forms(near).collect()}
    assert set(roots.values()) == {"aaaaaa" + "b" * 11}


# --- 12 ------------------------------------------------------------------------------------------


def counts_of(text):
    parts = [toxicity.measure(b) for b in w.blocks(pa.array([text], pa.string()))]
    return {k: int(v[0]) for k, v in parts[0].items()}


def test_toxic_counts():
    got = counts_of("You are an IDIOT, a $tupid m0ron and a looooser!! w.o.r.t.h.l.e.s.s you... I will kill it.")
    assert got["n_insults"] == 1 and got["n_disguised"] == 2 and got["n_stretched"] == 1 and got["n_spelled"] == 1
    assert got["n_you"] == 2 and got["n_threats"] == 1 and got["n_shouted"] == 1 and got["n_mark_runs"] == 1 and got["n_directed"] == 1
    assert all(v == 0 for k, v in counts_of("").items())
    clean = counts_of("Scunthorpe and the mississippi, 1000 bookkeepers; cost $5 each")
    assert not any(clean[k] for k in ("n_insults", "n_profane", "n_disguised", "n_stretched", "n_spelled", "n_directed"))
    texts = [None, "", "idiot", "x" * 5000, "idiot " * 300, "!", "é"]
    together = toxicity.measure(next(w.blocks(pa.array(texts), 1 << 20)))
    for i, t in enumerate(texts):
        assert {k: int(v[i]) for k, v in together.items()} == counts_of(t), t


def test_toxic_scores_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op12_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    seen = rows.where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    # one label in twenty or so is wrong in the tables
    assert sum(r.toxic == r.predicted for r in seen) >= 0.93 * len(seen)
    assert sum(r.toxic for r in seen if r.predicted) >= 0.9 * sum(r.predicted for r in seen)
    assert all(0 <= r.score <= 1 for r in seen) and rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_toxicity_of_odd_rows(spark):
    texts = ODD + ["you idiot, you moron"] * 20 + ["a plain text about the sea and its shores"] * 60
    docs = table(spark, [(i if i != 3 else None, t) for i, t in enumerate(texts)]).withColumn("_toxic_name", F.lit(1)).withColumn("margin", F.lit("m"))
    label = lambda t: 1 if t and "idiot" in t else 0
    rows = [(i, label(t)) for i, t in enumerate(texts)]
    labels = spark.createDataFrame(rows + rows[:5] + [(12, 7), (None, 1), (13, None)], "doc_id bigint, toxic int")
    got = toxicity.scored(docs, labels, "doc_id", "toxic", F.col("doc_id") % 5 != 0)
    assert set(got.columns) == {"doc_id", "_toxic_name", "margin", "_toxic_score"}
    scores = {r.doc_id: r._toxic_score for r in got.collect()}
    assert len(scores) == len(texts) and all(0 <= x <= 1 for x in scores.values())
    assert all((scores[i] >= 0.5) == (label(t) == 1) for i, t in enumerate(texts) if i != 3)
    for none in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        only = {r._toxic_score for r in toxicity.scored(docs, none, "doc_id", "toxic", F.lit(True)).collect()}
        assert len(only) == 1
    assert toxicity.scored(docs.limit(0), labels, "doc_id", "toxic", F.lit(True)).count() == 0


def test_toxic_words_come_from_the_labels(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    slurs = ["zorglak", "quimbert", "vöxnard", "plundrisk"]  # in no list
    texts = [" ".join(rng.choices(plain, k=25) + rng.sample(slurs, 2) * (i % 4 == 0)) for i in range(600)]
    docs = table(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600) if i % 5], "doc_id bigint, toxic int")
    held_out = {r.doc_id: r._toxic_score for r in toxicity.scored(docs, labels, "doc_id", "toxic", F.col("doc_id") % 5 != 0).collect() if r.doc_id % 5 == 0}
    assert len(held_out) == 120 and all((x >= 0.5) == (i % 4 == 0) for i, x in held_out.items())
    # heaviest word, sum of the heaviest, words that weigh, their share
    known, weights = np.array([1, 5, 9]), np.array([1.0, 0.0, 3.0])
    got = toxicity.strengths(np.array([1, 5, 9, 7, 9]), np.array([0, 3, 3, 5]), known, weights)
    assert got.tolist() == [[3.0, 4.0, 2.0, 2 / 3], [0.0] * 4, [3.0, 3.0, 1.0, 0.5]]
    assert not toxicity.strengths(np.array([1]), np.array([0, 1]), known[:0], weights[:0]).any()


# --- 13 ------------------------------------------------------------------------------------------


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_importance(docs, target):
    of = lambda texts: Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])
    s, t = of(x for _, x in docs), of(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    large = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for i, r in enumerate(large[: 5 * len(large) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["the", "Cat", "dog", "é", "x1", "end.", "Ōsaka", "rare" + str(rnd.random())]
    return [(i, rnd.choice((" ", "-", "\n", "\x00")).join(rnd.choice(words) for _ in range(rnd.randint(0, 80)))) for i in range(n)]


def test_importance_equals_brute_force(spark, monkeypatch):
    docs = corpus(1, 300) + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "the dog " * 15), (5, "the cat " * 12), (5, "the cat " * 12)]
    target = [t for _, t in corpus(2, 30)] + [None, "", "the cat the cat"]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    want = sorted(brute_importance(docs, target), key=repr)
    key = lambda r: (r.doc_id, r.n_features, r.weight, r.score, r.rank)
    got = importance.importance(table(spark, docs), items).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(key, got.collect()), key=repr) == want
    assert sum(r[4] is not None for r in want) > 5


def test_checksums_of_long_texts_in_pieces():
    for limit in (1, 7, 1 << 18):
        importance._pieces.__defaults__ = (limit,)
        for text in ("a b c d e f g" * 20, "é" * 50 + " x", "one", "", " , ", "世界 " * 30):
            words, want = features(text)
            parts = list(importance.checksums(text.encode()))
            assert sum(n for n, _ in parts) == len(words)
            assert Counter(x for _, p in parts for x in p) == Counter(zlib.crc32(f.encode()) for f in want)


def test_resample_keeps_rows(spark):
    docs = table(spark, corpus(3, 400)).withColumn("_importance_", F.lit(1)).withColumn("n_words", F.lit("n")).withColumn("score", F.lit(0))
    items = spark.createDataFrame([("the cat",)], "text string")
    ranks = {r.doc_id: r.rank for r in importance.importance(docs, items).collect()}
    drawn = importance.resample(docs, items)
    assert drawn.columns == docs.columns
    assert {r.doc_id for r in drawn.collect()} == {k for k, v in ranks.items() if v}
    assert importance.importance(docs.limit(0), items).count() == 0 and importance.resample(docs.limit(0), items).count() == 0
    assert importance.importance(docs, items.limit(0)).count() == docs.count()
