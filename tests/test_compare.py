import pytest
from pyspark.sql import functions as F

from reviewlens.operators import compare as c


def table(df):
    return {(r["PRODUCT_FAMILY"], r["ASPECT"]): r for r in df.collect()}


def test_overall_row_and_column_agree(reviews):
    got = table(c.compare_families(reviews))
    for (family, aspect), row in got.items():
        assert row["NET_SENTIMENT_OVERALL"] == got[(family, "OVERALL")]["NET_SENTIMENT_ASPECT"]
    assert got[("P ONE", "OVERALL")]["REVIEW_COUNT"] == 5


def test_overall_is_the_weighted_mean(reviews):
    rows = c.compare_families(reviews).collect()
    for o in (r for r in rows if r["ASPECT"] == "OVERALL"):
        parts = [r for r in rows if r["PRODUCT_FAMILY"] == o["PRODUCT_FAMILY"] and r["ASPECT"] != "OVERALL"]
        assert sum(p["NET_SENTIMENT_ASPECT"] * p["REVIEW_COUNT"] for p in parts) / o["REVIEW_COUNT"] == pytest.approx(o["NET_SENTIMENT_OVERALL"])


def test_rollup_row_is_the_whole_product(reviews):
    got = table(c.compare_families(reviews, families=["Q 100%_A"], rollup_product="p"))
    assert {k[0] for k in got} == {"Q 100%_A", "p"}
    assert got[("p", "OVERALL")]["REVIEW_COUNT"] == 6 and got[("p", "Price")]["REVIEW_COUNT"] == 4


def test_rollup_may_share_a_family_name(reviews):
    rows = c.compare_families(reviews.withColumn("Product_Family", F.col("Product")), rollup_product="P").collect()
    assert sum(r["PRODUCT_FAMILY"] == "P" and r["ASPECT"] == "OVERALL" for r in rows) == 2


def test_overlap_only(reviews):
    rows = c.compare_families(reviews, families=["P ONE", "P TWO"], overlap_only=True).collect()
    assert {r["ASPECT"] for r in rows} == {"Price", "OVERALL"}


def test_pivot_orders_by_volume(reviews):
    wide = c.comparison_pivot(c.compare_families(reviews), with_volume=True)
    rows = wide.collect()
    assert wide.columns[2:] == ["P ONE", "P TWO", "Q 100%_A"]
    volumes = [r["REVIEW_COUNT_TOTAL"] for r in rows]
    assert volumes == sorted(volumes, reverse=True) and rows[0]["ASPECT"] == "OVERALL"
    assert next(r for r in rows if r["ASPECT"] == "Price")["Q 100%_A"] is None


def test_pivot_first_takes_the_most_reviewed(spark):
    df = spark.createDataFrame([("A", "x", 1.0, 5), ("A", "x", 9.0, 7)], "PRODUCT_FAMILY string, ASPECT string, NET_SENTIMENT_ASPECT double, REVIEW_COUNT long")
    assert c.comparison_pivot(df, families=["A"], agg="first").first()["A"] == 9.0
    assert c.comparison_pivot(df, families=["A"]).first()["A"] == 5.0


def test_pivot_falls_back_to_product(spark):
    df = spark.createDataFrame([("A", "x", 1.0, 5)], "PRODUCT string, ASPECT string, NET_SENTIMENT_ASPECT double, REVIEW_COUNT long")
    assert c.comparison_pivot(df).columns == ["ASPECT", "A"]


def test_wins_over_others(reviews):
    got = c.aspect_wins(reviews, "P ONE", ["P TWO"]).collect()
    assert [(r["Aspect"], r["OTHERS_NET_SENTIMENT"]) for r in got] == [("Price", -100.0)]


def test_split(reviews):
    a, b = c.split_by_entity(c.compare_families(reviews), "P ONE", "P TWO")
    assert {r[0] for r in a.collect()} == {"P ONE"} and {r[0] for r in b.collect()} == {"P TWO"}
