"""Ranked search, hard negatives and language identification against brute force, and the rows that they must bear."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import compress_lang, hard_negatives, shared_search

SF = "/root/testdata/sf0.001"
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"w{k % 997} Q{k % 31}," for k in range(30000))
ODD = [
    (1, "One two three, four FIVE six!"), (1, "One two three, four FIVE six!"), (2, None), (3, ""), (4, " \t.-_\n "), (5, "ÀÉ İs\x1ct\x00one 日本 😀 x"),
    (6, LONG), (7, LONG + " one"), (None, "one nameless"), (8, "one"), (9, "ONE"), (10, "two_three 10"), (11, "ein zwei drei vier")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "de" if i == 11 else "en" if i else None, 3, "x", 1, 2.0, "y") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, place long, key string, block long, score double, held_out string")


# 11 ranked search


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def brute_ranks(docs, items, k=10):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_all, l_all = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c in held:
            m = 10 + 90 * c.total() * n_all // max(1, l_all)
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=str)


def test_terms():
    texts = pa.array([t for _, t in ODD])
    for part in (texts, texts[3:9], texts[6:], texts[:0]):
        counts, index, distinct = shared_search.terms(part)
        assert [distinct[i].as_py() for i in index] == [w for t in part.to_pylist() for w in terms(t)]
        assert counts.tolist() == [len(terms(t)) for t in part.to_pylist()]


@pytest.mark.parametrize("items", [
    [[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 6], [7], [], [1, 2, 3, 4]],
    [[1, 1, 2]], [], [list(range(k, k + 30)) for k in range(20)], [[k % 7, k % 5, k % 3, k] for k in range(200)]])
def test_graph_sums(items):
    """Every item is the sum of its own terms, and a node of two others serves two items at least."""
    graph = shared_search.Graph(items)
    arrays = graph.arrays()
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 40, (500, 3))
    terms_, own = np.array(graph.terms, np.int64), np.array([t for _, t in graph.own], np.int64)
    arrays |= {"keys": terms_, "weights": terms_, "own_keys": own, "own_weights": own}

    def impact(keys, _):
        row, doc = np.divmod(np.arange(3 * len(keys)), 3)
        return row, doc, values[keys[row], doc]
    got = shared_search.item_sums(arrays, impact, 3)
    assert got.tolist() == [values[sorted(set(i))].sum(0).tolist() if i else [0, 0, 0] for i in items]
    first, serving = len(terms_), collections.Counter()
    for tops in np.split(arrays["tops"], np.cumsum(arrays["top_sizes"])[:-1]) if items else []:
        left = tops.tolist()
        for node in left:
            serving[node] += 1
            left += arrays["pairs"][node - first].tolist() if node >= first else []
    assert all(serving[k] > 1 for k in range(first + len(arrays["pairs"])))


def test_graph_shares_work():
    items = [[*range(20), 100 + k] for k in range(50)]
    arrays = shared_search.Graph(items).arrays()
    assert len(arrays["pairs"]) + len(arrays["tops"]) < 100 < sum(map(len, items))


@pytest.mark.parametrize("block", [512, 7])
def test_ranked_against_brute_force(spark, block):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_ranks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = shared_search.ranked(docs, items, block_items=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 300


def test_ranked_odd(spark, odd, monkeypatch):
    items = [(1, "one TWO"), (1, "six"), (2, None), (3, "..."), (None, "日本 drei"), (4, "one one one"), (5, "nowhere"), (6, "w1 q2 one")]
    asked = spark.createDataFrame([(*i, 9, 9, 9) for i in items], "item_id long, text string, doc_id long, rank int, place long")
    want = brute_ranks(ODD, items)
    assert sorted(map(tuple, shared_search.ranked(odd, asked).collect()), key=str) == want
    monkeypatch.setattr(shared_search, "SLICE_SUMS", 8)  # many slices of a few documents
    assert sorted(map(tuple, shared_search.ranked(odd, asked, k=2).collect()), key=str) == brute_ranks(ODD, items, 2)
    assert shared_search.ranked(odd.limit(0), asked).collect() == [] == shared_search.ranked(odd, asked.limit(0)).collect()
    named = shared_search.ranked(odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), asked.withColumn("item_id", F.lit("q")))
    assert {r.item_id for r in named.collect()} == {"q"}


def test_ranked_with_a_third_of_copies(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "alpha beta").otherwise(F.concat(F.lit("alpha w"), "id")).alias("text"))
    items = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "w7 alpha")], "item_id long, text string")
    want = brute_ranks([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert sorted(map(tuple, shared_search.ranked(docs.repartition(7), items).collect()), key=str) == want


# 12 hard negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 64, 3), (33, 64, 70), (100, 17, 41), (64, 64, 64), (7, 0, 9), (0, 8, 4)])
def test_products(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(1 << 23), 1 << 23, (m, k)), rng.integers(-(1 << 23), 1 << 23, (n, k))
    for leaf in (1, 4, 16):
        assert (hard_negatives.product(a, b, leaf) == a @ b.T).all()


def test_heaps_merge():
    rng = np.random.default_rng(3)
    owner, score, ids = rng.integers(0, 6, 400), rng.integers(0, 9, 400), rng.permutation(400)
    one, many = hard_negatives.Heaps(4), hard_negatives.Heaps(4)
    one.add(owner, score, ids)
    for part in np.array_split(rng.permutation(400), 13):
        many.add(owner[part], score[part], ids[part])
    assert all((getattr(one, c) == getattr(many, c)).all() for c in ("owner", "score", "ids"))


def test_firsts_of_ties():
    scores = np.array([[5, 5, 5, 5, 1], [9, 1, 9, 2, 2]])
    wanted = np.array([[0, 1, 1, 1, 1], [1, 1, 0, 0, 0]], bool)
    rows, cols = hard_negatives.firsts(scores, wanted, 2)
    assert list(zip(rows.tolist(), cols.tolist())) == [(0, 1), (0, 2), (1, 0), (1, 1)]


def brute_negatives(rows, every=100):
    held = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 1 << 15 for x in v):
            continue
        held.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in held:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in held]
        mine = sorted((s, j) for s, j, other in scored if other == label and j != i)[:5]
        for p, j in mine:
            near = sorted((s, n) for s, n, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"anchor_rows": 2, "tile_rows": 16, "strip": 2}])
def test_negatives_against_brute_force(spark, sizes):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    want = brute_negatives([tuple(r) for r in vectors.collect()], 20)
    got = hard_negatives.hard_negatives(vectors, every=20, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_negatives_odd(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 0.5], 9), (100, [1.0], 0), (200, [], 3), (300, [nan, 1.0], 0), (400, [1.0, None], 0), (500, None, 1), (600, [1.0, 1.0], None),
            (700, [1.0, 0.0], 9), (700, [1.0, 0.0], 9), (None, [1.0, 1.0], 2), (1, [inf, 1.0], 0), (2, [1.0, 0.4], 0), (3, [1.0, 0.4], 0), (4, [0.9, 0.4], 5),
            (5, [0.9, 0.4], 5), (6, [-1.0, 0.0], 0), (8, [1e30, 0.0], 0), (9, [0.8, 0.9], 4), (9, [0.8, 0.9], 4), (10, [0.5, 0.5, 7.0], 6), (-100, [1.0, 0.2], 4)]
    rows += [(k, [0.75, 0.75], 5 + k % 2) for k in range(1001, 1061)]
    vectors = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, tile long, strip long, score string")
    got = sorted(map(tuple, hard_negatives.hard_negatives(vectors, anchor_rows=3, tile_rows=8, strip=1).collect()))
    assert got == brute_negatives([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert hard_negatives.hard_negatives(vectors.limit(0)).collect() == []
    assert hard_negatives.hard_negatives(vectors.filter("vec_id = 0")).collect() == []


# 13 language by compression


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "lang").join(compress_lang.languages(docs), "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r.held_out and r.lang]
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in out) > 0.96 * len(out)
    sure = [r for r in out if not r.rejected]
    assert len(sure) > 0.95 * len(out) and sum(r.lang == r.lang_pred for r in sure) > 0.98 * len(sure)
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_against_plain_compression(spark):
    """The same answers from one call of the library for each text, piece and dictionary."""
    import regex
    import zstandard
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs.withColumn("held_out", F.lit(True))
    samples = compress_lang.fit(docs)
    assert set(samples) == {r.lang for r in docs.select("lang").distinct().collect()}
    got = {r.doc_id: r for r in compress_lang.identified(held, samples).collect()}
    for row in docs.limit(60).collect():
        text = regex.sub(r"[^\p{L}\p{M}]+", " ", f" {row.text.lower()} ").encode()
        sizes = []
        for lang in sorted(samples):
            zdict = zstandard.ZstdCompressionDict(samples[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made = zstandard.ZstdCompressor(level=compress_lang.LEVEL, dict_data=zdict, write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(made.compress(text[k:k + compress_lang.PIECE])) for k in range(0, len(text), compress_lang.PIECE)), lang))
        first, second = sorted(sizes)[:2]
        assert got[row.doc_id].lang_pred == first[1] and math.isclose(got[row.doc_id].score, 1 - first[0] / second[0])


def test_languages_odd(spark, odd):
    rows = compress_lang.languages(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"} and {r.lang_pred for r in rows if r.doc_id in (1, 6, 7, 8)} <= {"de", "en"}
    assert all(r.rejected and r.score == 0 for r in rows if r.lang_pred == "und") and all(0 <= r.score <= 1 for r in rows)
    assert compress_lang.languages(odd.limit(0)).collect() == []
    unlabelled = compress_lang.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    single = compress_lang.languages(odd.withColumn("lang", F.lit("xx"))).collect()
    assert {(r.lang_pred, r.score) for r in single} == {("xx", 1.0), ("und", 0.0)}


def test_a_language_with_a_third_of_copies(spark):
    """A text that occurs very often takes one place in the sample."""
    copies = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("der die das und nicht").alias("text"), F.lit("de").alias("lang"))
    others = spark.createDataFrame([(1000 + k, t, lang) for k, (t, lang) in enumerate(itertools.product(["the of and this that", "une dans pour avec les"], ["en"]))],
                                   "doc_id long, text string, lang string")
    assert compress_lang.fit(copies.union(others))["de"].decode().count("nicht") == 1
