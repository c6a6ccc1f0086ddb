import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import ranking as rk


@pytest.fixture
def parts(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("parts", [1, 7, 40], indirect=True)
def test_rank_max_matches_pandas(spark, parts):
    rnd = random.Random(3)
    # One value and one partition hold most rows.
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice("ab"), None if rnd.random() < 0.1 else
             5.0 if rnd.random() < 0.4 else float(rnd.randrange(60))) for _ in range(800)]
    rows.append(("only null", None))
    got = rk.rank_max(spark.createDataFrame(rows, "p string, x double"), "x", ["p"]).toPandas()
    want = pd.DataFrame(rows, columns=["p", "x"])
    want["RANK"] = want.groupby("p")["x"].rank(method="max", ascending=False, na_option="bottom").astype(int)

    def key(t):
        return sorted(map(str, t[["p", "x", "RANK"]].fillna(-1).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_rank_max_without_partition(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double")
    assert sorted((r["x"] or 0, r["RANK"]) for r in rk.rank_max(df, "x").collect()) == [(0, 4), (1.0, 3), (2.0, 2), (2.0, 2)]


def test_ranks_of_a_frequent_value_do_not_meet_in_one_task(spark):
    """Rows of a value that half of all have are spread; each task of the join gets a fair share."""
    df = spark.range(20000).selectExpr("'hot' as p", "if(id % 2 = 0, 1.5, cast(id % 500 as double)) as x")
    found = rk.rank_max(df, "x", ["p"])
    assert found.filter("x = 1.5").select("RANK").distinct().collect()[0][0] == df.filter("x >= 1.5").count()
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        sizes = [r[1] for r in rk.rank_max(df, "x", ["p"]).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert len(sizes) >= 3 and max(sizes) < 0.5 * sum(sizes)


def test_odd_rows_of_rank_max(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (float("nan"), 2.0), (float("nan"), 2.0), (1.0, None)], "p double, x double")
    got = sorted((str(r["p"]), str(r["x"]), r["RANK"]) for r in rk.rank_max(df, "x", ["p"]).collect())
    assert got == [("1.0", "None", 1), ("None", "1.0", 2), ("None", "2.0", 1), ("nan", "2.0", 2), ("nan", "2.0", 2)]
    assert rk.rank_max(df.limit(0), "x", ["p"]).collect() == []


def test_min_max_moves_no_row(spark, tmp_path):
    """One hot group: the rows are scanned, look their bounds up, and are not shuffled."""
    spark.range(5000).selectExpr("if(id % 10 < 9, 'hot', concat('g', id % 7)) as p", "cast(id as double) as x").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = rk.min_max(df, "x", ["p"])._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    a, b = (sorted(map(str, rk.min_max(df, "x", ["p"], many=many).collect())) for many in (False, True))
    assert a == b and len(a) == 5000


@pytest.mark.parametrize("many", [False, True])
def test_min_max_zero_range_is_null(spark, many):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), (None, 4.0), (None, 5.0)], "p string, x double")
    got = {(r["p"], r["x"]): r["NORMALIZED"] for r in rk.min_max(df, "x", ["p"], many=many).collect()}
    assert got == {("a", 1.0): 0.0, ("a", 3.0): 1.0, ("b", 2.0): None, (None, 4.0): 0.0, (None, 5.0): 1.0}


def reference_ranking(frame):
    """The ranking of one family, by hand in pandas."""
    f = frame[(frame.ASPECT_SENTIMENT != 0) & ~frame.ASPECT.isin(["Generic", "TOTAL"])].copy()
    s = (f.ASPECT_SENTIMENT - f.ASPECT_SENTIMENT.min()) / (f.ASPECT_SENTIMENT.max() - f.ASPECT_SENTIMENT.min())
    n = (f.REVIEW_COUNT - f.REVIEW_COUNT.min()) / (f.REVIEW_COUNT.max() - f.REVIEW_COUNT.min())
    f["r"] = ((1 - s) + 3 * n).rank(method="max", ascending=False, na_option="bottom")
    return list(f.sort_values(["r", "ASPECT"]).ASPECT)


def test_aspect_ranking(spark):
    frame = pd.DataFrame({"ASPECT": ["TOTAL", "Price", "Design", "Generic", "Battery", "Screen", "Zero"],
                          "ASPECT_SENTIMENT": [10.0, -5.0, 30.0, 1.0, 12.0, 12.0, 0.0],
                          "REVIEW_COUNT": [100, 40, 10, 30, 15, 15, 5]})
    got = rk.aspect_ranking(spark.createDataFrame(frame), k=None).orderBy("PLACE").collect()
    assert [r["ASPECT"] for r in got] == reference_ranking(frame)
    assert {r["ASPECT"]: r["ASPECT_RANKING"] for r in got}["Battery"] == 3  # ties take the larger rank
    no_total = spark.createDataFrame(frame[frame.ASPECT != "TOTAL"])
    assert [r["ASPECT"] for r in rk.aspect_ranking(no_total, k=2).orderBy("PLACE").collect()] == reference_ranking(frame)[:2]


def test_ranking_of_a_single_aspect(spark):
    df = spark.createDataFrame([("Price", 5.0, 3)], "ASPECT string, ASPECT_SENTIMENT double, REVIEW_COUNT int")
    row = rk.aspect_ranking(df).first()
    assert (row["ASPECT_RANKING"], row["PLACE"]) == (1, 1)


def test_top_k_and_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1)], "g string, n int")
    assert rk.top_k_per_group(df, ["g"], [F.desc("n")], 1).count() == 2
    assert rk.rank_top(df, ["g"], [F.desc("n")]).count() == 3


def test_recent_history(spark):
    df = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(6)] + [(2, 0, "user", "x")],
                               "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"], r["turn"]) for r in rk.recent_history(df).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 0)]


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = rk.top_k_per_group(df, ["g"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
