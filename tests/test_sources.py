import json
import os
import time

import pytest
from pyspark.sql import functions as F

from reviewlens.functions.vocabulary import TITLE_LABELS
from reviewlens.sources.storage import FILE_CLEANUP, cut_lineage, fresh_folder, shared_folder
from reviewlens.sources import schema as S, tables as io


def test_review_csv_with_line_breaks_and_quotes(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('Review,Data_Source,Geography,Title,Review_Date,Product,Product_Family,Sentiment,Aspect,Keywords\n'
                    '"Says ""ok""\nand more, much",web,US,t,2024-01-05,prod,fam one,Positive,Price,e-mail\n')
    row = io.read_reviews(spark, str(path), labels=TITLE_LABELS).first()
    assert row["Review"] == 'Says "ok"\nand more, much' and row["Product_Family"] == "FAM ONE"
    assert (row["Keywords"], row["Sentiment_Score"], str(row["Review_Date"])) == ("E-Mail", 1, "2024-01-05")


def test_missing_columns_are_named(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "x.parquet"))
    with pytest.raises(ValueError, match="Sales_Units"):
        io.read_sales(spark, str(tmp_path / "x.parquet"), source_format="parquet")


def test_stored_reviews_are_read_by_format_and_filtered_in_the_scan(spark, tmp_path):
    from reviewlens.operators.measures import net_sentiment
    from reviewlens.functions.matching import apply_filters
    path = str(tmp_path / "plain")
    row = {"Review": "fine", "Product_Family": "fam one", "Aspect": "Price", "Sentiment": "positive"}
    df = spark.createDataFrame([tuple(row.get(f) for f in S.REVIEWS.fieldNames())], S.REVIEWS)
    io.write_reviews(df, path)
    stored = io.read_reviews(spark, path, source_format="parquet", folded=True)
    assert [(r["Product_Family"], r["Sentiment_Score"]) for r in stored.collect()] == [("FAM ONE", 1)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = apply_filters(stored, [("Product_Family", "equals", "fam one"), ("Aspect", "pri")], folded=True)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Product_Family,FAM ONE)" in plan and "StringContains(Aspect,PRI)" in plan
    assert net_sentiment(stored) is not None


def test_a_csv_row_that_does_not_fit_is_an_error(spark, tmp_path):
    (tmp_path / "m.csv").write_text("SalesDevice,SentimentDevice\na,b,c,d\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_mapping(spark, str(tmp_path / "m.csv")).collect()


def test_sales_csv(spark, tmp_path):
    names = S.SALES.fieldNames()
    values = {"Month": "3/1/2023", "Sales_Units": "5", "Sales_Value": "10.25", "ASP": "2.05", "Series": "S"}
    path = tmp_path / "s.csv"
    path.write_text(",".join(names) + "\n" + ",".join(values.get(n, "x" if n != "SCREEN_SIZE_INCHES" else "13.5") for n in names) + "\n")
    row = io.read_sales(spark, str(path)).first()
    assert str(row["Month"]) == "2023-03-01" and str(row["Sales_Value"]) == "10.25"


def test_history_round_trip_and_append(spark, tmp_path):
    path = str(tmp_path / "h")
    df = spark.createDataFrame([(1, 0, "user", 'line\n"two"')], S.HISTORY)
    io.write_history(df, path)
    io.write_history(df, path)
    assert [r["text"] for r in io.read_history(spark, path).collect()] == ['line\n"two"'] * 2


def test_answer_list(spark, tmp_path):
    path = tmp_path / "h.json"
    path.write_text(json.dumps(["first\nanswer", "second"], indent=1))
    assert [(r["turn"], r["text"]) for r in io.read_answer_list(spark, str(path)).collect()] == [(0, "first\nanswer"), (1, "second")]


def test_whole_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    assert io.read_text(spark, str(tmp_path / "a.txt")).first()["text"] == "one\n\ntwo"


def test_entity_reviews_keep_whole_texts(spark, tmp_path):
    path = str(tmp_path / "e")
    texts = [' lead and trail ', 'tab\there', 'quote " in', 'line\nbreak', '']
    df = spark.createDataFrame([("A#1 X", t) for t in texts], "Product_Family string, Review string")
    io.write_entity_reviews(df, path)
    assert len([d for d in os.listdir(path) if d.startswith("Product_Family=")]) == 1
    back = (spark.read.schema("Review string, Product_Family string")
            .options(sep="\t", header=True, quote='"', escape='"', multiLine=True).csv(path).collect())
    assert sorted(r["Review"] or "" for r in back) == sorted(texts) and {r["Product_Family"] for r in back} == {"A#1 X"}


def test_hot_entity_is_split_over_files(spark, tmp_path):
    path = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        df = spark.range(20_000).selectExpr("'HOT' AS Product_Family", "repeat(cast(id AS string), 5) AS Review").repartition(4)
        io.write_entity_reviews(df, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in os.listdir(os.path.join(path, "Product_Family=HOT")) if f.endswith(".csv")]
    assert len(files) > 1


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_folder(spark, "x") != fresh_folder(spark, "x")


def test_executors_do_not_need_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from reviewlens.functions.similarity import Letters

    sent = cloudpickle.dumps(lambda: Letters(["ORBIT GO"]).alike("GO ORBIT 3", 60)[1].tolist())
    code = "import pickle, sys; print(pickle.loads(sys.stdin.buffer.read())())"
    ran = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd=tmp_path, timeout=60)
    assert ran.stdout.decode().strip() == "[100.0]", ran.stderr.decode()


def test_filters_of_operators_reach_the_scan(spark, reviews, tmp_path):
    """Stored reviews say that their keys are folded, and operators hand that on."""
    from reviewlens.functions.matching import mark_folded
    from reviewlens.operators.keywords import keyword_stats
    from reviewlens.operators.measures import aspect_summary, net_sentiment
    from reviewlens.operators.sales import units_k
    path = str(tmp_path / "r")
    mark_folded(reviews, "Product_Family").write.parquet(path)
    stored = spark.read.parquet(path)

    def pushed(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan[plan.index("PushedFilters"):].split("]")[0]

    assert "StringContains(Product_Family,P ONE)" in pushed(aspect_summary(stored, "p one"))
    assert "StringContains(Product_Family,P ONE)" in pushed(keyword_stats(stored, "p one"))
    assert "EqualTo(Product_Family,P ONE)" in pushed(net_sentiment(stored, filters=[("Product_Family", "equals", "p one")]))
    sold = str(tmp_path / "s")
    spark.sql("select 'S1' as Series, 5L as Sales_Units").write.parquet(sold)
    sales = mark_folded(spark.read.parquet(sold), "Series")
    assert "EqualTo(Series,S1)" in pushed(units_k(sales, "s1", match="equals")) and units_k(sales, "s1").first()["SALES_UNITS_K"] == 0.005
    assert sorted(map(tuple, aspect_summary(stored, "p one").collect()), key=str) == sorted(map(tuple, aspect_summary(reviews, "p one").collect()), key=str)


def test_a_cut_lineage_removes_its_shuffle_files(spark):
    disk, setting = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.get(FILE_CLEANUP, None)

    def files():
        return {str(f) for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before = files()
    kept = cut_lineage(counted)
    stop = time.time() + 20  # they are removed after the call has returned
    while files() - before and time.time() < stop:
        time.sleep(0.1)
    assert not files() - before
    assert sorted(kept.collect()) == sorted(counted.collect()) == sorted(counted.collect()) and kept.count() == 10
    assert spark.conf.get(FILE_CLEANUP, None) == setting
