"""Net sentiment per family and time window over a stream of scored reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewlens.functions.scoring import net_sentiment_of


def windowed_net_sentiment(stream: DataFrame, window: str = "1 day", lateness: str = "1 hour",
                           time: str = "ts", family: str = "Product_Family") -> DataFrame:
    """One row per family and closed window; a review later than ``lateness`` is left out."""
    return (stream.withWatermark(time, lateness)
            .groupBy(F.window(time, window).alias("span"), family)
            .agg(net_sentiment_of().alias("NET_SENTIMENT"), F.count(F.lit(1)).alias("REVIEW_COUNT"))
            .select(F.col("span.start").alias("WINDOW_START"), family, "NET_SENTIMENT", "REVIEW_COUNT"))


def run_to_files(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what the source holds now and stop. Files and checkpoint make a restart exact."""
    query = (result.writeStream.format("parquet").outputMode(mode)
             .option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
