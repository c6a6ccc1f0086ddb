import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import lists as ls, neighbours as nb, text as tx
from reviewlens.sources import snapshots as sn


def cloud(spark, n=3000, centres=40):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(centres, 8)) * 5
    rows = [(i, [float(x) for x in middles[rng.integers(centres)] + rng.normal(size=8)]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def pairs(found):
    return {(r["query_id"], r["vec_id"]) for r in found.collect()}


def test_recall_of_lists(spark, tmp_path):
    """Against the exact search: nine in ten at least, from a small part of the lists."""
    vectors = cloud(spark)
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    path = str(tmp_path / "index")
    ls.build_lists(vectors.filter("vec_id < 2500"), path, list_rows=60)
    ls.append_lists(vectors.filter("vec_id >= 2400"), path)
    ls.append_lists(vectors.filter("vec_id >= 2400"), path)  # once more changes nothing
    assert sn.read_table(spark, f"{path}/lists").count() == 3000
    centres, probes = ls._centres(spark, path)
    assert probes <= len(centres) / 4
    exact, found = pairs(nb.knn(asked, vectors, 4)), pairs(ls.knn_lists(asked, path, 4))
    assert len(exact & found) >= 0.9 * len(exact)
    assert pairs(ls.knn_lists(asked, path, 4, probes=len(centres))) == exact


def test_recall_of_the_given_vectors(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    ls.build_lists(vectors, str(tmp_path / "i"), list_rows=64)
    exact, found = pairs(nb.knn(asked, vectors)), pairs(ls.knn_lists(asked, str(tmp_path / "i")))
    assert len(exact & found) >= 0.9 * len(exact)


def test_lists_of_odd_vectors(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)] + [(99, None)], "vec_id long, embedding array<float>")
    ls.build_lists(same, str(tmp_path / "i"), list_rows=4)
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "query_id long, embedding array<float>")
    assert [(r["query_id"], r["distance"]) for r in ls.knn_lists(asked, str(tmp_path / "i"), 2).collect()] == [(1, 0.0)] * 2
    assert ls.knn_lists(asked.limit(0), str(tmp_path / "i")).collect() == []
    with pytest.raises(ValueError):
        ls.build_lists(same.limit(0), str(tmp_path / "j"))


def rows(spark, path, version=None):
    return sorted(map(tuple, sn.read_table(spark, path, version).collect()))


def test_changes_by_id(spark, tmp_path):
    path = str(tmp_path / "t")
    def make(*r):
        return spark.createDataFrame(r, "id long, v string")
    assert sn.upsert(make((1, "a"), (2, "b"), (None, "x"), (2, "b")), path, "id", 4) == 1
    assert sn.upsert(make((2, "c"), (3, "d")), path, "id") == 2
    assert rows(spark, path) == [(1, "a"), (2, "c"), (3, "d")]
    assert sn.upsert(make((2, "c"), (3, "d")), path, "id") == 3 and rows(spark, path) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(spark, path, 1) == [(1, "a"), (2, "b")]
    assert sn.upsert(make((1, "z")).limit(0), path, "id") == 4 and len(rows(spark, path)) == 3
    with pytest.raises(FileNotFoundError):
        sn.read_table(spark, str(tmp_path / "none"))


def test_a_broken_change_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    sn.upsert(spark.range(50).selectExpr("id", "'old' as v"), path, "id", 4)
    broken = spark.range(50).selectExpr("id", "if(id = 49, raise_error('lost'), 'new') as v")
    with pytest.raises(Exception):
        sn.upsert(broken, path, "id")
    assert {r["v"] for r in sn.read_table(spark, path).collect()} == {"old"}
    sn.upsert(spark.range(50).selectExpr("id", "'new' as v"), path, "id")
    assert {r["v"] for r in sn.read_table(spark, path).collect()} == {"new"} and sn.read_table(spark, path).count() == 50


def test_an_index_of_texts_extended_twice(spark, tmp_path):
    path = str(tmp_path / "index")
    for texts in (["alpha beta", "gamma"], ["gamma delta"], ["gamma delta"]):
        tx.extend_index(spark.createDataFrame([(i, t) for i, t in enumerate(texts, 5)], "id long, t string"), path, ["id"], "t")
    got = {dict(map(tuple, r["metadata"]))["id"]: r["text"] for r in sn.read_table(spark, path).collect()}
    assert got == {"5": "gamma delta", "6": "gamma"}


def test_queries_are_routed_without_copies(spark, tmp_path, monkeypatch):
    """A query is written once, however many lists it looks into."""
    vectors = cloud(spark, 600)
    ls.build_lists(vectors, str(tmp_path / "i"), list_rows=20)
    asked, written, real = vectors.select(F.col("vec_id").alias("query_id"), "embedding"), [], ls.cut_lineage
    monkeypatch.setattr(ls, "cut_lineage", lambda df: written.append(df.count()) or real(df))
    found = ls.knn_lists(asked, str(tmp_path / "i"), probes=30)
    assert written == [600] and pairs(found) == pairs(nb.knn(asked, vectors))


def test_equal_vectors_need_no_more_memory():
    """2,000 queries that tie with 8,000 points: 16 million pairs, of which a few million numbers are held at a time."""
    import tracemalloc
    points = np.ones((8000, 64))
    tracemalloc.start()
    rows, ids, distance = nb.nearest(points[:2000], points, np.arange(8000)[::-1].copy(), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    assert (ids.reshape(-1, 4) == [0, 1, 2, 3]).all() and (distance == 0).all() and (rows == np.repeat(np.arange(2000), 4)).all()
