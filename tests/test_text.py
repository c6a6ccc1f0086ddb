import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewlens.operators import neighbours as nb, text as tx


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_chunks_fit_and_lose_nothing(text, size, overlap):
    chunks = tx.split_text(text, size, overlap) if text else []
    assert all(0 < len(c) <= size and c in text for c in chunks)
    plain = tx.split_text(text, size, 0) if text else []
    assert "".join("".join(plain).split()) == "".join(text.split())


def test_cuts_at_the_coarsest_place():
    text = "one two\n\nthree four\n\nfive"
    assert tx.split_text(text, 12, 0) == ["one two", "three four", "five"]
    assert tx.split_text("aaa bbb ccc", 7, 0) == ["aaa bbb", "ccc"]
    assert tx.split_text("aaa bbb ccc", 8, 4) == ["aaa bbb", "bbb ccc"]
    assert tx.split_text("abcdefgh", 3, 0) == ["abc", "def", "gh"]
    assert tx.split_text("a\nbbbbbbbb\nc", 4, 0) == ["a", "bbb", "bbbb", "b", "c"]


def test_short_text_is_one_chunk(spark):
    df = spark.createDataFrame([(1, "short"), (2, ""), (3, None), (4, "x " * 9000)], "id int, t string")
    got = tx.chunk_text(df, "t", 10_000, 200).orderBy("id", "chunk_no").collect()
    assert [(r["id"], r["chunk_no"]) for r in got] == [(1, 0), (4, 0), (4, 1)]
    assert got[0]["chunk"] == "short" and sum(len(r["chunk"]) for r in got[1:]) >= 17_900


def test_overlap_is_checked(spark):
    with pytest.raises(ValueError):
        tx.chunk_text(spark.createDataFrame([("a",)], "t string"), "t", 10, 10)


def test_embeddings_are_unit_vectors(spark):
    df = spark.createDataFrame([(1, "good screen"), (2, "good screen"), (3, "weak battery life"), (4, None)], "id int, chunk string")
    got = {r["id"]: np.array(r["embedding"]) for r in tx.embed(df, "chunk", dims=64).collect()}
    assert np.allclose(got[1], got[2]) and abs(np.linalg.norm(got[3]) - 1) < 1e-5 and not got[4].any()
    assert len(got[1]) == 64 and not np.allclose(got[1], got[3])


def test_own_embedder(spark):
    df = spark.createDataFrame([("abc",), ("de",)], "chunk string")
    got = tx.embed(df, "chunk", lambda texts: [[len(t), 1.0] for t in texts]).orderBy("chunk").collect()
    assert [r["embedding"] for r in got] == [[3.0, 1.0], [2.0, 1.0]]


def test_index_appends_and_combines(spark, tmp_path):
    path = str(tmp_path / "index")
    one = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id int, t string")
    tx.build_index(one, path, ["id"], "t")
    tx.build_index(spark.createDataFrame([(3, "delta")], "id int, t string"), path, ["id"], "t")
    table = spark.read.parquet(path)
    assert table.count() == 3 and table.select("vec_id").distinct().count() == 3
    assert {r["metadata"]["id"] for r in table.collect()} == {"1", "2", "3"}
    assert tx.union_index(table, table.drop("text")).groupBy("origin").count().count() == 2


def brute(queries, vectors, k):
    out = {}
    for q, qv, qp in queries:
        ranked = sorted((float(np.linalg.norm(np.subtract(qv, v))), i) for i, v, p in vectors if p == qp)
        out[q] = [i for _, i in ranked[:k]]
    return out


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6)) * 6
    rows = []
    for i in range(600):
        v = centres[rng.integers(5)] + rng.normal(size=6)
        part = "hot" if rng.random() < 0.7 else f"p{rng.integers(3)}"
        rows.append((i, [float(np.float32(x)) for x in v], part))
    rows += [(600 + j, rows[7][1], rows[7][2]) for j in range(6)]  # equal vectors
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string").repartition(5)


def answers(found):
    out = {}
    for r in found.orderBy("query_id", "RANK").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def as_queries(vectors):
    return vectors.select(F.col("vec_id").alias("query_id"), "embedding", "part")


@pytest.mark.parametrize("k", [1, 4])
def test_both_ways_match_brute_force(cloud, k):
    rows, df = cloud
    same = [(i, v, "") for i, v, _ in rows]
    want = brute(same, same, k)
    assert answers(nb.knn(as_queries(df), df, k)) == want
    assert answers(nb.knn(as_queries(df), df, k, block=250)) == want
    assert answers(nb.knn_large(as_queries(df), df, k, pivots=9, cell_rows=40)) == want
    assert answers(nb.knn_large(as_queries(df), df, k)) == want


def test_within_partition(cloud):
    rows, df = cloud
    assert answers(nb.knn(as_queries(df), df, 3, partition="part")) == brute(rows, rows, 3)
    assert answers(nb.knn_large(as_queries(df), df, 3, "part", pivots=30, cell_rows=10)) == brute(rows, rows, 3)


def test_queries_are_sent_to_few_cells(cloud, monkeypatch):
    rows, df = cloud
    sent = {}
    real = nb.match_blocks
    monkeypatch.setattr(nb, "match_blocks", lambda left, *a: sent.update(rows=left.count()) or real(left, *a))
    nb.knn_large(as_queries(df), df, 2, pivots=12, cell_rows=20)
    assert sent["rows"] < len(rows) * 12 / 2


def test_blocks_split_a_hot_cell(cloud, monkeypatch):
    from reviewlens.operators import blocks
    rows, df = cloud
    monkeypatch.setattr(nb, "match_blocks", lambda *a: blocks.match_blocks(*a, left_rows=50, right_rows=70))
    assert answers(nb.knn(as_queries(df), df, 3, partition="part")) == brute(rows, rows, 3)


def test_fewer_vectors_than_k(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    assert answers(nb.knn(q, df, 5)) == {1: [1, 2], 2: [2, 1]} == answers(nb.knn_large(q, df, 5))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0])], "query_id long, embedding array<float>")
    assert nb.knn(q, df).count() == 0 and nb.knn_large(q, df).count() == 0


def test_a_text_has_one_vector_in_every_table(spark):
    texts = ["Battery lasts long", "screen is dim and the battery weak", "nothing alike"]
    one = spark.createDataFrame([(0, texts[0])], "id int, t string")
    all_ = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert tx.embed(one, "t").first()["embedding"] == tx.embed(all_, "t").filter("id = 0").first()["embedding"]


def test_a_stored_chunk_answers_itself(spark, tmp_path):
    path = str(tmp_path / "index")
    for part in (["battery lasts long", "screen is dim"], ["keyboard clacks loudly"]):
        tx.build_index(spark.createDataFrame([(hash(t) % 1000, t) for t in part], "id long, t string"), path, ["id"], "t")
    asked = spark.createDataFrame([(1, "Screen is dim"), (2, "keyboard clacks loudly"), (3, "how long lasts the battery")], "query_id long, question string")
    got = {r["query_id"]: r["text"] for r in tx.ask(asked, spark.read.parquet(path), 1).collect()}
    assert got == {1: "screen is dim", 2: "keyboard clacks loudly", 3: "battery lasts long"}


def test_fixed_windows_cover_the_text(spark):
    texts = ["", None, "a", "abcdefghij", "abcdefghijk", "x" * 95, "日本語テキスト" * 9]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id int, t string, _text string").drop("_text")
    got = {}
    for r in tx.fixed_windows(df, "t", 10, 3).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append((r["chunk_no"], r["chunk"]))
    for i, t in enumerate(texts):
        want, begin = [], 0
        while t and (not want or begin + 3 < len(t)):
            want.append((len(want), t[begin:begin + 10]))
            begin += 7
        assert got.get(i, []) == want


def test_texts_are_cut_a_few_megabytes_at_a_time(spark, monkeypatch):
    texts = ["ab " * 300_000, None, "", *(f"{i} " * 200_000 for i in range(40))]
    steps = []
    df = spark.createDataFrame([], "id long, text string, tags array<string>")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: steps.append((fn, schema)))
    tx.chunk_text(df, "text")
    (fn, schema), = steps
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([["a"]] * len(texts)), pa.array(texts)], ["id", "tags", "text"])
    out = list(fn(iter([batch])))
    assert max(b.nbytes for b in out) < 6 << 20 < batch.nbytes
    got = [(r["id"], r["chunk_no"], r["chunk"], r["tags"]) for b in out for r in b.to_pylist()]
    assert got == [(i, n, c, ["a"]) for i, t in enumerate(texts) if t for n, c in enumerate(tx.split_text(t))]
    assert schema.names == ["id", "tags", "chunk_no", "chunk"]


def test_large_search_writes_a_query_once(cloud, monkeypatch):
    """Its copies for the cells that it meets are made on the way to their blocks."""
    rows, df = cloud
    written, real = [], nb.cut_lineage
    monkeypatch.setattr(nb, "cut_lineage", lambda d: written.append(d.count()) or real(d))
    assert answers(nb.knn_large(as_queries(df), df, 2, pivots=12, cell_rows=20)) == brute([(i, v, "") for i, v, _ in rows], [(i, v, "") for i, v, _ in rows], 2)
    assert written == [len(rows)] * 2
