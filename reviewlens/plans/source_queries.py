"""Readers and writers: each table is written below the shared folder and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from reviewlens.plans.registry import query
from reviewlens.sources import bindings as bind, schema as S, tables as io
from reviewlens.sources.storage import fresh_folder

_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


@query("src1_review_csv", """SELECT doc_id, Review, upper(Product_Family) AS Product_Family, Geography, Sentiment,
  CASE Sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS Sentiment_Score FROM text_reviews""", "text_reviews")
def _(spark, d):
    path = fresh_folder(spark, "review-csv")
    rows = bind.text_reviews(spark, d)
    rows.write.options(**_CSV).csv(path)
    return io.read_reviews(spark, path, schema=rows.schema)


@query("src2_sales_csv", """SELECT Month, Series, CAST(sum(Sales_Units) AS BIGINT) AS SALES_UNITS, CAST(sum(Sales_Value) AS DOUBLE) AS SALES_VALUE
FROM sales GROUP BY 1, 2""", "sales")
def _(spark, d):
    path = fresh_folder(spark, "sales-csv")
    rows = bind.sales(spark, d, "Month_Text", "Series", "Sales_Units", "Sales_Value", "ASP").withColumnRenamed("Month_Text", "Month")
    rows.write.options(**_CSV).csv(path)
    fields = {f.name: f for f in S.SALES.fields}
    schema = T.StructType([fields[c] for c in rows.columns])
    return io.read_sales(spark, path, schema).groupBy("Month", "Series").agg(
        F.sum("Sales_Units").alias("SALES_UNITS"), F.sum("Sales_Value").cast("double").alias("SALES_VALUE"))


@query("src3_mapping_csv", "SELECT * FROM name_mapping", "name_mapping")
def _(spark, d):
    path = fresh_folder(spark, "mapping-csv")
    bind.name_mapping(spark, d).write.options(**_CSV).csv(path)
    return io.read_mapping(spark, path)


@query("src4_history_json", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, d):
    path = fresh_folder(spark, "history-json")
    io.write_history(bind.history(spark, d), path)
    return io.read_history(spark, path)


@query("src5_whole_text", "SELECT source, text FROM documents")
def _(spark, d):
    """Text files of up to a hundred documents of a source, one JSON string a line, read back whole and cut into lines."""
    path = fresh_folder(spark, "texts")
    docs = bind.table(spark, d, "documents").select("source", F.to_json(F.struct("text")).alias("value"))
    docs.write.partitionBy("source").option("maxRecordsPerFile", 100).text(path)
    lines = F.split("text", "\n")
    return io.read_text(spark, f"{path}/*").select(
        F.regexp_extract("path", r"source=([^/]+)/", 1).alias("source"),
        F.explode(F.slice(lines, 1, F.size(lines) - 1)).alias("line")).select("source", F.get_json_object("line", "$.text").alias("text"))


@query("src1_review_parquet", """SELECT Product_Family, count(*) AS REVIEWS, sum(CASE Sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END) AS SCORE
FROM (SELECT upper(Product_Family) AS Product_Family, Sentiment FROM text_reviews) GROUP BY 1""", "text_reviews")
def _(spark, d):
    """Stored once with folded keys in a folder whose name says nothing, and read under the schema."""
    path = fresh_folder(spark, "reviews")
    rows = bind.text_reviews(spark, d)
    io.write_reviews(rows, path)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "Sentiment_Score"])
    stored = io.read_reviews(spark, path, schema=schema, source_format="parquet", folded=True)
    return stored.groupBy("Product_Family").agg(F.count(F.lit(1)).alias("REVIEWS"), F.sum("Sentiment_Score").cast("long").alias("SCORE"))


@query("src6_vectors", "SELECT label, count(*) AS VECTORS, max(len(embedding)) AS DIMENSIONS FROM embeddings GROUP BY label")
def _(spark, d):
    vectors = io.read_vectors(spark, f"{d.rstrip('/')}/embeddings.parquet")
    return vectors.groupBy("label").agg(F.count(F.lit(1)).alias("VECTORS"),
                                        F.max(F.size("embedding")).cast("long").alias("DIMENSIONS"))


@query("snk1_entity_reviews", "SELECT Product_Family, Review FROM text_reviews", "text_reviews")
def _(spark, d):
    path = fresh_folder(spark, "entity-reviews")
    io.write_entity_reviews(bind.text_reviews(spark, d), path)
    schema = T.StructType([T.StructField("Review", T.StringType()), T.StructField("Product_Family", T.StringType())])
    return spark.read.schema(schema).options(sep="\t", multiLine=True, **_CSV).csv(path)


@query("snk2_history", "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn + 100, role, text FROM conversations")
def _(spark, d):
    path = fresh_folder(spark, "history")
    turns = bind.history(spark, d)
    io.write_history(turns, path)
    io.write_history(turns.withColumn("turn", F.col("turn") + 100), path)
    return io.read_history(spark, path)


@query("snk3_vectors", "SELECT vec_id, label, len(embedding) AS DIMENSIONS FROM embeddings")
def _(spark, d):
    path = fresh_folder(spark, "vectors")
    io.write_vectors(bind.vectors(spark, d), path)
    return io.read_vectors(spark, path).select("vec_id", "label", F.size("embedding").cast("long").alias("DIMENSIONS"))
