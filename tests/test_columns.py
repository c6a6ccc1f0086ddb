import pytest
from pyspark.sql import functions as F

from reviewlens.functions import formatting as fmt, scoring
from reviewlens.functions.vocabulary import TITLE_LABELS


def one(spark, value, expr, kind="double"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize("label, score", [("positive", 1), ("negative", -1), ("neutral", 0), ("Positive", 0), (None, 0)])
def test_labels_are_exact(spark, label, score):
    assert one(spark, label, scoring.sentiment_score("x"), "string") == score


def test_second_vocabulary(spark):
    df = spark.createDataFrame([("Positive",), ("Negative",), ("positive",)], "Sentiment string")
    assert [r["Sentiment_Score"] for r in scoring.with_score(df, TITLE_LABELS).collect()] == [1, -1, 0]


def test_zero_denominator_gives_null(spark):
    assert one(spark, 0.0, scoring.percent(F.lit(1), F.col("x"))) is None


@pytest.mark.parametrize("text", ["e-mail", "3d view", "they're", "ALL CAPS", "a1b2", "übung macht", "", " two  gaps "])
def test_title_case_matches_python(spark, text):
    assert one(spark, text, fmt.title_case("x"), "string") == text.title()


@pytest.mark.parametrize("value, expected", [(0.25, 0.2), (0.35, 0.4), (-0.25, -0.2), (2.675, 2.7), (1.05, 1.0), (None, None)])
def test_half_even(spark, value, expected):
    assert one(spark, value, fmt.half_even("x")) == expected


def test_half_up(spark):
    assert one(spark, 0.25, fmt.half_up("x")) == 0.3 and one(spark, -0.25, fmt.half_up("x")) == -0.3


def test_round_numeric_leaves_whole_numbers(spark):
    df = spark.createDataFrame([(15, 1.25, "a")], "n int, x double, s string")
    assert tuple(fmt.round_numeric(df).first()) == (15, 1.2, "a")


@pytest.mark.parametrize("value, stars", [(-100.0, (0, 0, 5)), (0.0, (2, 1, 2)), (15.7, (2, 1, 2)), (20.0, (3, 0, 2)),
                                          (100.0, (5, 0, 0)), (None, None)])
def test_star_rating(spark, value, stars):
    got = one(spark, value, fmt.star_rating("x"))
    assert (tuple(got) if got else None) == stars


@pytest.mark.parametrize("value, color", [(-100.0, "#b0343c"), (0.0, "#dcdcdc"), (100.0, "#347c47"),
                                          (-250.0, "#b0343c"), (250.0, "#347c47"), (50.0, "#88ac91"), (None, None)])
def test_heat_color(spark, value, color):
    assert one(spark, value, fmt.heat_color("x")) == color


def test_heat_color_without_width_is_middle(spark):
    assert one(spark, 7.0, fmt.heat_color("x", 7, 7)) == "#dcdcdc"


def test_heat_color_truncates_first(spark):
    assert one(spark, 50.9, fmt.heat_color("x", truncate=True)) == "#88ac91"


def test_impact(spark):
    df = spark.createDataFrame([(1.0,), (2.04,), (3.0,)], "NET_SENTIMENT double")
    assert [r["Impact"] for r in fmt.with_impact(df, 2.0).collect()] == ["LOW", " ", "HIGH"]


@pytest.mark.parametrize("text, value", [("1,234", 1234), ("12", 12), ("1,234,567.0", 1234567), ("x", None), (None, None)])
def test_parse_count(spark, text, value):
    assert one(spark, text, fmt.parse_count("x"), "string") == value


def test_labels_and_dates(spark):
    assert one(spark, 2.5, fmt.fmt_thousands("x")) == "2K"
    assert one(spark, 799.6, fmt.fmt_usd("x")) == "$800"
    assert str(one(spark, "03/01/2023", fmt.parse_month("x"), "string")) == "2023-03-01"
    assert one(spark, "03/01/2023", fmt.year_of("x"), "string") == "2023"
    assert one(spark, "03/01/2023", fmt.month_of("x"), "string") == "03"


def test_keys_keep_null(spark):
    df = spark.createDataFrame([("a b", None, "e-mail"), (None, "x", None)], "Product string, Product_Family string, Keywords string")
    assert [tuple(r) for r in fmt.normalize_keys(df).collect()] == [("A B", None, "E-Mail"), (None, "X", None)]


def test_to_int_truncates(spark):
    df = spark.createDataFrame([(-1.9, "a"), (1.9, "b"), (None, "c")], "x double, s string")
    assert [r["x"] for r in fmt.to_int(df).collect()] == [-1, 1, None]
