"""Chunks, embeddings and neighbours over the whole document and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewlens.operators import lists as ls, neighbours as nb, text as tx
from reviewlens.plans.registry import query
from reviewlens.sources import bindings as bind, tables as io
from reviewlens.sources.snapshots import read_table, upsert
from reviewlens.sources.storage import fresh_folder


@query("txt1_chunks")
def _(spark, d):
    return tx.chunk_text(bind.table(spark, d, "documents").select("doc_id", "text"), "text")


@query("txt1_fixed_windows", """SELECT doc_id, CAST(i AS INT) AS chunk_no, substr(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - 1000) / 900) AS BIGINT)))) AS i FROM documents WHERE length(text) > 0)""")
def _(spark, d):
    return tx.fixed_windows(bind.table(spark, d, "documents").select("doc_id", "text"), "text", 1000, 100)


@query("txt1_chunk_coverage", """SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS LETTERS, true AS WITHIN_SIZE, true AS PARTS_OF_THE_TEXT, true AS NUMBERED
FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0""")
def _(spark, d):
    """What must hold of the chunks of a text: none is too long, all are parts of it, and without an overlap they hold every letter."""
    docs = bind.table(spark, d, "documents").select("doc_id", "text")
    chunks = tx.chunk_text(docs, "text", 1000, 0)
    whole = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("whole"))
    held = chunks.join(whole, F.col("doc_id") == F.col("id")).select(
        "doc_id", "chunk_no", F.char_length("chunk").alias("size"), F.col("whole").contains(F.col("chunk")).alias("part"),
        F.char_length(F.regexp_replace("chunk", r"\s", "")).cast("long").alias("letters"))
    return held.groupBy("doc_id").agg(
        F.sum("letters").alias("LETTERS"), F.max(F.col("size") <= 1000).alias("WITHIN_SIZE"), F.min("part").alias("PARTS_OF_THE_TEXT"),
        (F.max("chunk_no") + 1 == F.count(F.lit(1))).alias("NUMBERED"))


@query("txt2_embedded_chunks")
def _(spark, d):
    chunks = tx.chunk_text(bind.table(spark, d, "documents").select("doc_id", "text"), "text")
    return tx.embed(chunks, "chunk").drop("chunk")


@query("txt3_vector_index")
def _(spark, d):
    folder = fresh_folder(spark, "index")
    tx.build_index(bind.table(spark, d, "documents"), folder, ["doc_id", "source"], "text")
    stored = io.read_vectors(spark, folder)
    joined = tx.union_index(stored, bind.vectors(spark, d).select("vec_id", "embedding"))
    return joined.groupBy("origin").agg(F.count(F.lit(1)).alias("VECTORS"), F.count_distinct("vec_id").alias("IDS"))


@query("txt3_upserted_vectors", """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS label, len(embedding) AS DIMENSIONS
FROM embeddings WHERE label < 7 OR vec_id % 3 = 0""")
def _(spark, d):
    """A stored table of the first labels, changed by id for every third vector, twice."""
    folder = fresh_folder(spark, "table")
    vectors = bind.vectors(spark, d).select("vec_id", "embedding", "label")
    upsert(vectors.filter("label < 7"), folder, "vec_id", 8)
    for _ in range(2):
        upsert(vectors.filter("vec_id % 3 = 0").withColumn("label", F.lit(-1)), folder, "vec_id")
    return read_table(spark, folder).select("vec_id", "label", F.size("embedding").alias("DIMENSIONS"))


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").alias("query_id"), "embedding", "label")


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("distance", F.round("distance", 6))


def _knn_sql(same_label: bool = False) -> str:
    return f"""SELECT query_id, vec_id, round(d, 6) AS distance, r AS RANK FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM (
    SELECT q.vec_id AS query_id, v.vec_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS d
    FROM embeddings q JOIN embeddings v ON {'q.label = v.label' if same_label else 'true'})) WHERE r <= 4"""


@query("txt4_knn", _knn_sql())
def _(spark, d):
    vectors = bind.vectors(spark, d)
    return _rounded(nb.knn(_queries(vectors), vectors))


@query("txt4_knn_of_label_centres", """SELECT query_id, vec_id, round(d, 6) AS distance, r AS RANK FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM (
    SELECT q.label AS query_id, v.vec_id, list_distance(q.centre, CAST(v.embedding AS DOUBLE[])) AS d
    FROM (SELECT label, list(m ORDER BY i) AS centre FROM (
            SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, generate_series(1, 64) g(i) GROUP BY label, i)
          GROUP BY label) q, embeddings v)) WHERE r <= 4""")
def _(spark, d):
    vectors = bind.vectors(spark, d)
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    # One entry per dimension and label.
    centres = means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("embedding"))
    return _rounded(nb.knn(centres, vectors))


@query("txt5_knn_large", _knn_sql())
def _(spark, d):
    vectors = bind.vectors(spark, d)
    return _rounded(nb.knn_large(_queries(vectors), vectors))


@query("txt5_knn_approx")
def _(spark, d):
    """Every vector against a stored index of lists; held to the exact search in the tests."""
    folder = fresh_folder(spark, "lists")
    vectors = bind.vectors(spark, d)
    ls.build_lists(vectors, folder, list_rows=64)
    return _rounded(ls.knn_lists(_queries(vectors), folder))


@query("txt6_knn_within_entity", _knn_sql(same_label=True))
def _(spark, d):
    vectors = bind.vectors(spark, d)
    return _rounded(nb.knn(_queries(vectors), vectors, partition="label"))
