"""Words, quality rules, classifier, decontamination, packing and language model on small tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowlens.llm import (
    decontaminate,
    lm_score,
    packing,
    quality_classifier,
    quality_rules,
    queries,
    substring_dedup,
    url_filter,
)
from rowlens.llm import words as w

LOWER = {i: i + 32 for i in range(65, 91)}
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\n", "a", "A  b\tc\nA b c\n\nA b c", "é ü  ñ　x", "😀 😀", "x" * 30_000, "tic " * 9_000,
    "# * | <b> $5 100% & more\n# * | <b> $5 100% & more",
]


def split(text):
    return [x for x in BLANKS.split(text or "") if x]


def random_texts(n, seed=5):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "an", "Cat", "dog", "é", "x1", "end.", "|", "#", "\n", "\n", "  ", "\t"]
    return [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return ODD + random_texts(120)


def table(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for k, v in more.items():
        df = df.withColumn(k, v)
    return df


def test_spans_and_hashes(texts):
    seen = {}
    for block in w.blocks(pa.array(texts), 500):
        found = w.spans(block, w.NOT_BLANK)
        for at, (row, word) in enumerate(zip(found.rows, w.span_strings(block.data, found.starts, found.ends).to_pylist(), strict=True)):
            seen.setdefault(block.first + row, []).append(word)
        hashes = w.span_hashes(block.data, found.starts, found.ends)
        for k in (1, 3, 8, 13):
            for i, g in zip(range(len(hashes)), w.gram_hashes(hashes, k), strict=False):
                assert g == w.gram_hashes(hashes[i : i + k], k)[0]
                break
    assert {k: v for k, v in seen.items()} == {i: split(t) for i, t in enumerate(texts) if split(t)}


def test_quality_counts(spark, texts):
    got = {r.doc_id: r.c for r in table(spark, texts).select("doc_id", quality_rules.text_counts(F.col("text")).alias("c")).collect()}
    for i, t in enumerate(texts):
        t, x = t or "", split(t)
        grams = Counter(tuple(x[j : j + 8]) for j in range(len(x) - 7))
        inside = {k for j in range(len(x) - 7) if grams[tuple(x[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [s for s in t.split("\n") if split(s)]
        want = (len(x), sum(map(len, x)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert tuple(got[i][c] for c in quality_rules.BASE) == want, t[:80]


def test_quality_rules_adapt_to_their_group(spark):
    plain = "Some words that nobody would mind reading in a row of twenty or more words, number {} of them here today and tomorrow."
    rows = [(i, plain.format(i), "en", "a") for i in range(300)]
    rows += [(1000 + i, plain.format(i).replace(" ", " | "), "en", "tables") for i in range(300)]
    rows += [(2000, plain.format(1).replace(" ", " | "), "en", "a"), (2001, None, None, None), (2002, plain.format(3), None, "few")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    judged = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert all(judged[i]._q_kept for i in range(300))
    assert all(judged[1000 + i]._q_kept for i in range(300))  # a table source is judged by its own sketch
    assert not judged[2000]._q_kept and judged[2001]._q_base_failed and judged[2002]._q_kept
    assert quality_rules.judge(df.where("false")).count() == 0


def test_quality_rules_take_fences_from_the_data(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    prose = lambda n=60, caps=2: " ".join(word().title() if i < caps else word() for i in range(n))
    rows = [(i, prose(caps=rnd.randint(3, 9)), "en", f"s{i % 3}") for i in range(900)]
    rows += [(1000 + i, " ".join("$" + x for x in prose().split()), "en", "s0") for i in range(45)]  # an eighth of s0 is junk
    rows += [(2000, prose(60, 50).upper().title(), "en", "s1")]  # 1 in 7 letters is a capital
    rows += [(3000, f"{prose()}\n{(line := prose(9, 1))}\n{line}", "en", "s1")]  # one repeat in three lines
    rows += [(4000, "\n".join([prose(5, 1), *[prose(9, 1)] * 5]).replace("\n", " \n"), "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    judged = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert all(judged[i]._q_kept for i in range(900)) and judged[3000]._q_kept
    assert not any(judged[1000 + i]._q_kept for i in range(45))
    assert not judged[2000]._q_base_failed and not judged[2000]._q_kept and not judged[4000]._q_kept
    counted = df.select("lang", "source", quality_rules.text_counts(F.col("text")).alias("c"))
    rates = [v.alias(k) for k, v in quality_rules.measures("c").items()]
    fences = {(r.source, r.measure): r.fence for r in quality_rules.thresholds(counted.select("lang", "source", *rates)).collect()}
    assert fences["s0", "symbols"] < 1.05 * fences["s1", "symbols"]  # its junk lifts nothing


def test_no_constant_gives_the_verdicts_of_the_fences(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.join(spark.createDataFrame([(f"src{i}", i) for i in range(20)], "source string, k int"), "source")
    # half of the sources write formulas: a symbol in every third word or so is usual there
    formula = F.when(F.col("k") % 2 == 0, F.regexp_replace("text", "(\\w+ \\w+) (\\w+)", "$1 &$2")).otherwise(F.col("text"))
    docs = docs.select("doc_id", formula.alias("text"), "lang", "source")
    thresholds = quality_rules.thresholds
    own = {r.doc_id: r._q_kept for r in quality_rules.judge(docs).select("doc_id", "_q_kept").collect()}
    for share in (0.0, 0.5, 1.0):

        def one_for_all(measured, min_group=200, share=share):
            found = thresholds(measured, min_group)
            same = found.groupBy("measure").agg(F.percentile("fence", F.lit(share)).alias("fence"))
            return found.drop("fence").join(same, "measure")

        monkeypatch.setattr(quality_rules, "thresholds", one_for_all)
        other = {r.doc_id: r._q_kept for r in quality_rules.judge(docs).select("doc_id", "_q_kept").collect()}
        assert sum(own[k] != v for k, v in other.items()) > 50


def test_quality_rules_write_no_texts(spark, monkeypatch):
    plain = "Some words that nobody would mind reading in a row of twenty or more words, number {} of them here today and tomorrow."
    rows = [(i, plain.format(i).replace(" ", " | " if i % 50 == 0 else " "), "en", f"s{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows + [(1000, None, None, None)], "doc_id bigint, text string, lang string, source string")
    written, write = [], quality_rules.materialize
    monkeypatch.setattr(quality_rules, "materialize", lambda df, label: (written.extend(df.columns), write(df, label))[1])
    own = quality_rules.judge(df)
    assert written and not {"text", "_q_counts"} & set(written)
    plan = own.where("_q_kept")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", -1)  # texts are dealt by group
    assert sorted(quality_rules.judge(df).collect(), key=str) == sorted(own.collect(), key=str)


def test_quality_rules_of_odd_rows(spark):
    rows = [(1, None, None, None, 1), (None, "", "en", None, 2), (2, "word " * 30, None, "s", 3), (2, "word " * 30, None, "s", 3), (3, "x" * 9000, "en", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _q_counts int")
    got = quality_rules.judge(df, prefix="_r_")
    assert got.columns[:5] == df.columns and sorted(r._q_counts for r in got.collect()) == [1, 2, 3, 3, 4]


def test_quality_rules_keep_labelled_clean_rows(spark):
    got = queries.QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    assert {(r.quality, r.kept) for r in rows} == {(1, True), (0, False)}


def test_sketch_error_and_merge(spark):
    df = spark.range(1, 5001).select(F.pmod("id", F.lit(7)).alias("g"), (F.col("id") / 10.0).alias("m"))
    sketched = quality_rules.sketch(df, ["g"], ["m"])
    for r in quality_rules.quantiles(sketched, [], {"q": 0.5, "r": 0.9}).collect():
        assert abs(r.q - 250) < 250 * 0.03 and abs(r.r - 450) < 450 * 0.03 and r.n == 5000


def test_classifier(spark):
    rnd = np.random.default_rng(1)
    x = np.concatenate((rnd.normal(0, 1, (400, 11)), rnd.normal(1.2, 2, (400, 11))))
    rows = [(i, [float(v) for v in x[i]], int(i >= 400)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id bigint, x array<double>, y int")
    model = quality_classifier.fit(df, "x", "y", to_pooled=0.0, to_identity=0.0)
    scores = np.array([r.s for r in df.select("doc_id", quality_classifier.scored(F.col("x"), model).alias("s")).orderBy("doc_id").collect()])

    def density(part):
        cov, diff = np.cov(part.T, bias=True), x - part.mean(axis=0)
        return -0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1]

    want = 1 / (1 + np.exp(-(density(x[400:]) - density(x[:400]))))
    assert np.abs(scores - want).max() < 1e-6
    empty = quality_classifier.fit(df.where("y = 1"), "x", "y")
    assert empty.score(x[:2]).tolist() == [1.0, 1.0]
    assert quality_classifier.fit(df.where("false"), "x", "y").share == 0.5


def test_classifier_held_out(spark):
    got = queries.QUERIES["op6_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(docs, items, window=13):
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    known = {}
    for label, t in items:
        x = words(t)
        k = min(window, len(x))
        for j in range(len(x) - k + 1) if k else ():
            known.setdefault(tuple(x[j : j + k]), set()).add("" if label is None else str(label))
    out = {}
    for i, t in docs:
        x, hit, found = words(t), set(), set()
        for size in {len(k) for k in known}:
            for j in range(len(x) - size + 1):
                if tuple(x[j : j + size]) in known:
                    hit.update(range(j, j + size))
                    found |= known[tuple(x[j : j + size])]
        out[i] = (len(x), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_encoder_keeps_pieces_between_blocks(most, monkeypatch):
    """Ids are those of each whole text, however often known pieces are forgotten."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    monkeypatch.setattr(packing.Encoder, "MOST", most)
    with open(path, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    rnd = random.Random(8)
    piece = lambda: rnd.choice(["the", " the", "  x", "\u3000", "\u00a0é", "日本", "\n", "\t9", "<|endoftext|>", f" {rnd.randint(0, 999)}"])
    for _ in range(6):
        texts = ["".join(piece() for _ in range(rnd.randint(0, 60))) for _ in range(30)]
        for block in w.blocks(pa.array(texts), 500):
            ids, first, _, _ = encoder.encode(block)
            got = [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]
            want = [plain.encode(t, add_special_tokens=False).ids for t in texts[block.first : block.first + block.rows]]
            assert got == want


@pytest.mark.parametrize("block_chars", [800_000, 300])
def test_decontamination(spark, monkeypatch, block_chars):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block_chars)
    rnd = random.Random(3)
    word = lambda: rnd.choice("a b c d e".split())
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 3, 13, 14, 30])))) for i in range(25)]
    items += [(3, "x y z"), (None, "q r s t"), (30, None), (31, "Straße 7, Straße 8!")]
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 200)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "Q; R, s t? x-y"), (103, "straße 7 STRASSE straße 7 straße 8"), (104, "a " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n_words", F.lit(1)).repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.match(df, bench).select(
        "doc_id", "_match.n_words", decontaminate.hit_words(F.col("_match.runs")).alias("hit"), F.array_sort("_match.items").alias("items")
    )
    assert {r.doc_id: (r["n_words"], r.hit, r["items"]) for r in got.collect()} == hits(docs, items)


def test_clean_cuts_and_drops(spark):
    item = " ".join(f"k{i}" for i in range(20))
    far = " ".join(f"w{i}" for i in range(600))
    docs = [(1, f"{item} and a few"), (2, f"{far}. {item}! {far}"), (3, far), (4, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r._text for r in decontaminate.clean(df, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got == {2: f"{far}. ! {far}", 3: far, 4: None}
    assert decontaminate.clean(df, spark.createDataFrame([], "item_id bigint, text string")).count() == 4


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    source = queries.tokenizer_json()
    tokenizer = Tokenizer.from_str(source)
    tokenizer.encode_special_tokens = True
    odd = [*texts, "<|endoftext|> it's", "a\u00a0 b \u00a0c\u3000 d", "a\u2003 b\u0085 c  \n\n d"]
    df = table(spark, odd).unionByName(table(spark, odd[:5]))
    rows = packing.pack(df, source, length=64).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(odd)}
    total, places = Counter(), {}
    for r in rows:
        x = ids[r.doc_id]
        part = np.array(x[r.start : r.start + r.length], "<u4")
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(part.tobytes()) and 0 < r.length == len(part)
        total[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == {i: len(x) * (2 if i < 5 else 1) for i, x in ids.items()}
    short = 0
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
        short += at < 64
    assert short <= 1 and sorted(places) == list(range(len(places)))
    assert packing.pack(df.where("false"), source).count() == 0


def test_packing_loads_no_vocabulary_on_the_driver(spark, texts, monkeypatch):
    source = queries.tokenizer_json()
    docs = table(spark, texts[:40])
    monkeypatch.setitem(sys.modules, "tokenizers", None)  # of this process; workers have their own
    assert packing.pack(docs, source).agg(F.countDistinct("doc_id")).first()[0] == 40


def test_hilbert_neighbours():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(points, 3)
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
    assert sorted(keys) == list(range(512)) and (steps == 1).all()


def test_lattice_sums_all_segmentations():
    pieces = sorted([b"a", b"b", b"ab", b" a", b" ", b"aba", b" ab", b"bb"])
    weights = np.arange(1, 9) / 40
    lattice = lm_score.Lattice(pieces, weights)

    def brute(text):
        return sum(weights[i] * brute(text[len(p) :]) for i, p in enumerate(pieces) if text.startswith(p)) if text else 1.0

    words_ = ["a", "ab", "abab", "aabba", "bbbbabaab"]
    data, offsets = np.frombuffer("".join(words_).encode(), np.uint8), np.cumsum([0, *map(len, words_)])
    score, uses = lattice.run(data, offsets, np.ones(5))
    assert np.allclose(np.exp(score), [brute(b" " + x.encode()) for x in words_])
    # expected uses are the gradient by the log weights
    for i in range(8):
        bent = lm_score.Lattice(pieces, weights * np.where(np.arange(8) == i, 1 + 1e-6, 1)).run(data, offsets)[0]
        assert abs((bent - score).sum() / 1e-6 - uses[i]) < 1e-3


@pytest.mark.parametrize("frequent", [1 << 20, 3])
def test_lm_score(spark, texts, monkeypatch, frequent):
    import public_tokenizers

    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    df = table(spark, texts)
    held = queries.remainder("doc_id", 5) == 1
    rows = {r.doc_id: r for r in lm_score.score(df, public_tokenizers.path("piece_bpe_32k.model"), held).collect()}
    tokens = {i: [*split((t or "").translate(LOWER)), "\n"] for i, t in enumerate(texts)}
    taught = Counter()
    for i, x in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            taught.update(x)
    total, kinds = sum(taught.values()), len(taught)
    for i, x in tokens.items():
        base = sum(math.log10((taught[v] + 0.5) / (total + 0.5 * (kinds + 1))) for v in x)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(taught[v] > 0 for v in x), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and math.isfinite(r.score)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    # held-out texts do not move the model
    other = df.withColumn("text", F.when(held, F.lit("something else")).otherwise(F.col("text")))
    again = {r.doc_id: r for r in lm_score.score(other, public_tokenizers.path("piece_bpe_32k.model"), held).collect()}
    assert all(math.isclose(again[i].score, rows[i].score, rel_tol=1e-9) for i in rows if not rows[i].held_out)


@pytest.mark.parametrize("window", [8, 35])
def test_substring_dedup(spark, window):
    rnd = random.Random(window)
    passage = [f"p{i}" for i in range(90)]
    docs = [(i, " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 60)))) for i in range(30)]
    for i in range(30, 60):
        a = rnd.randint(0, 60)
        part = passage[a : a + rnd.randint(1, 70)]
        docs.append((i, "\n".join([docs[i - 30][1], "  ".join(part), f"end{i}"])))
    docs += [(70, None), (71, ""), (72, "same " * 400), (73, docs[5][1]), (74, " ".join(passage)), (74, " ".join(passage)), (None, "same " * 40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    counts = Counter()
    for _, t in docs:
        x = split(t)
        counts.update(tuple(x[j : j + window]) for j in range(len(x) - window + 1))
    want = []
    for i, t in docs:
        x = split(t)
        gone = {k for j in range(len(x) - window + 1) if counts[tuple(x[j : j + window])] > 1 for k in range(j, j + window)}
        kept = " ".join(v for j, v in enumerate(x) if j not in gone)
        want.append((i, len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.digests(df, window=window, gram=4)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(want, key=repr)
    texts_ = {(r.doc_id, r.kept) for r in substring_dedup.remove(df, window=window, gram=4).collect()}
    assert {hashlib.sha256(k.encode()).hexdigest() for _, k in texts_} == {r[3] for r in want}
    assert substring_dedup.digests(df.where("false")).count() == 0


def test_url_filter_keeps_columns_and_takes_odd_tables(spark, monkeypatch):
    urls = [None, "", "no scheme", "https://a.org/" + "x" * 50_000, "https://a.org/x"] * 3
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    pages = pages.withColumn("block", F.lit("b")).withColumn("w0", F.lit(0)).withColumn("key", F.lit("k"))
    listed = spark.createDataFrame([("http://www.a.org/x/",)], "url string")
    for most in (url_filter.BROADCAST_BYTES, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", most)
        got = url_filter.judge(pages, listed, []).collect()
        assert {(r.page_id % 5, r.block, r.w0, r._verdict) for r in got} == {(i, "b", 0, "block" if i == 4 else "allow") for i in range(5)}
        assert len(got) == len(urls) and url_filter.judge(pages.limit(0), listed, []).count() == 0


def test_url_filter(spark):
    urls = [
        "HTTP://www.A.org/x/?b=2&utm_source=q&a=1#f", "http://a.org/x?a=1&b=2", "http://a.org/y", None, "", "no scheme", "://", "x://B.net",
        "http://sub.net/", "http://net/", "http://xnet/", "https://q.EXAMPLE.net/en/1", "https://q.example.net/EN/1", "http://example.com/de/",
        "http://a.example.org/fr/x", "a://b://c/d?e#f", "http://fr.org/fr/",
    ]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0])], "page_id bigint, url string")
    df = df.withColumn("host", F.lit("own")).withColumn("rule", F.lit("own"))
    listed = spark.createDataFrame([("https://a.org/x?a=1&b=2",), (None,), ("bad",)], "url string")
    got = {r.page_id: r for r in url_filter.judge(df, listed, queries.URL_RULES).collect()}
    assert [got[i]._verdict for i in range(3)] == ["block", "block", "allow"] and got[None]._verdict == "block"
    assert (got[3]._host, got[3]._path, got[3]._verdict) == ("", "", "allow")
    assert [got[i]._rule for i in range(7, 17)] == [
        None, "net/", "net/", None, "example.net/en/", "net/", "example.com/de/", "org/fr/", None, "org/fr/",
    ]
    assert (got[15]._host, got[15]._path) == ("b:", "//c/d")
    assert url_filter.judge(df, listed.where("false"), queries.URL_RULES).where("_verdict = 'block'").count() == 4


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).selectExpr("concat('k', id) AS k")
    rows = spark.range(20000).selectExpr("concat('k', id) AS key")
    tested = url_filter.possible(rows, "key", listed, "k")
    assert tested.where("_possible AND int(substr(key, 2)) < 3000").count() == 3000
    assert tested.where("_possible AND int(substr(key, 2)) >= 3000").count() < 17000 * 0.02
