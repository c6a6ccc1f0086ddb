"""Streams over the whole event and conversation tables, run until the source is used up."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from reviewlens.plans.registry import query
from reviewlens.sources import bindings as bind
from reviewlens.sources.storage import fresh_folder
from reviewlens.streaming.history import rolling_history
from reviewlens.streaming.reviews import run_to_files, windowed_net_sentiment


def _stream(spark, d, name):
    """A table as a stream, whether it is one file or a folder of files: a path with a pattern may name either."""
    schema = bind.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/[{name[0]}]{name[1:]}.parquet")


@query("str1_windowed_net_sentiment", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS WINDOW_START, 'USER_' || CAST(user_id AS VARCHAR) AS Product_Family,
  CAST(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS NET_SENTIMENT,
  count(*) AS REVIEW_COUNT
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def _(spark, d):
    result = windowed_net_sentiment(bind.event_reviews(_stream(spark, d, "events")))
    path = fresh_folder(spark, "stream-sentiment")
    run_to_files(result, f"{path}/rows", f"{path}/state")
    return spark.read.parquet(f"{path}/rows").withColumn("WINDOW_START", F.col("WINDOW_START").cast("timestamp_ntz"))


@query("str2_rolling_history", """SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4""")
def _(spark, d):
    path = fresh_folder(spark, "stream-history")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream = rolling_history(_stream(spark, d, "conversations"))
    (stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state")
     .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.parquet(f"{path}/rows")
    newest = F.max("batch").over(Window.partitionBy("conv_id"))
    return rows.withColumn("newest", newest).filter("batch = newest").select("conv_id", "turn", "role", "text")
