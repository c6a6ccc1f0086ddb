from pyspark.sql import functions as F

from reviewlens.functions.scoring import with_score
from reviewlens.streaming.history import rolling_history
from reviewlens.streaming.reviews import run_to_files, windowed_net_sentiment


def test_late_reviews_are_left_out(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def feed(*rows):
        df = spark.createDataFrame(rows, "ts string, Product_Family string, Sentiment string")
        with_score(df.withColumn("ts", F.to_timestamp("ts"))).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        run_to_files(windowed_net_sentiment(stream), out, state)
        return sorted((str(r["WINDOW_START"])[:10], r["Product_Family"], r["NET_SENTIMENT"], r["REVIEW_COUNT"])
                      for r in spark.read.parquet(out).collect())

    first = feed(("2024-01-01 10:00:00", "A", "positive"), ("2024-01-01 11:00:00", "A", "negative"),
                 ("2024-01-01 12:00:00", "A", "positive"), ("2024-01-02 02:00:00", "A", "negative"))
    assert first == [("2024-01-01", "A", 100 / 3, 3)]
    # A review of the closed day comes too late; the next day closes with what it has.
    second = feed(("2024-01-01 13:00:00", "A", "negative"), ("2024-01-03 02:00:00", "B", "positive"))
    assert second == [("2024-01-01", "A", 100 / 3, 3), ("2024-01-02", "A", -100.0, 1)]


def test_history_keeps_the_newest_turns(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    seen = []

    def feed(*rows):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        query = (rolling_history(stream, 3).writeStream.outputMode("update")
                 .foreachBatch(lambda df, _: seen.append(sorted((r["conv_id"], r["turn"]) for r in df.collect())))
                 .option("checkpointLocation", state).trigger(availableNow=True).start())
        query.awaitTermination()

    feed((1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "c"))
    feed((1, 4, "u", "e"), (1, 3, "u", "d"))
    feed((1, 2, "u", "late"))
    assert [s for s in seen if s] == [[(1, 0), (1, 1), (2, 0)], [(1, 1), (1, 3), (1, 4)], [(1, 2), (1, 3), (1, 4)]]


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    from reviewlens.plans import registry
    registry.load()
    turns = [(c, t, "user", f"{c} {t}") for c in (1, 2, 3) for t in range(c + 3)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, 0, "user", "another table")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/turns.parquet")
    got = sorted(map(tuple, registry.QUERIES["str2_rolling_history"](spark, str(tmp_path)).collect()))
    assert got == [r for r in turns if r[1] >= r[0] - 1]
    spark.sql("select id as event_id, id % 3 as user_id, timestamp_ntz '2024-01-01' + make_dt_interval(0, id) as ts, 'purchase' as event_type from range(100)").repartition(2).write.parquet(
        f"{tmp_path}/events.parquet")
    found = registry.QUERIES["str1_windowed_net_sentiment"](spark, str(tmp_path)).collect()
    assert sum(r["REVIEW_COUNT"] for r in found) == 96
