import pytest
from pyspark.sql import functions as F

from reviewlens.functions import matching as m


@pytest.fixture
def names(spark):
    return spark.createDataFrame([("BRAND#2",), ("Brand#20",), ("100%_A",), ("a.b",), (None,)], "name string")


def hits(df, condition):
    return sorted(r["name"] for r in df.filter(condition).collect() if r["name"])


def test_contains_and_equals_differ(names):
    assert hits(names, m.ci_contains("name", "brand#2")) == ["BRAND#2", "Brand#20"]
    assert hits(names, m.ci_equals("name", "brand#2")) == ["BRAND#2"]


@pytest.mark.parametrize("text, found", [("%", ["100%_A"]), ("_", ["100%_A"]), (".", ["a.b"]), ("a.b", ["a.b"]), ("axb", [])])
def test_search_text_is_literal(names, text, found):
    assert hits(names, m.ci_contains("name", text)) == found


def test_negation_drops_null(names):
    assert hits(names, ~m.ci_contains("name", "brand")) == ["100%_A", "a.b"]


def test_any_of_nothing_is_nothing(names):
    assert hits(names, m.any_contains("name", [])) == []


def test_unknown_filter_finds_null(names):
    assert m.apply_filters(names, [("name", "unknown")]).count() == 1
    assert m.apply_filters(names, [("name", "brand"), ("name", "20")]).count() == 1


def test_match_is_checked():
    with pytest.raises(ValueError):
        m.ci_match("name", "x", "regex")


def test_totals_dropped_from_any_text_column(spark):
    df = spark.createDataFrame([("TOTAL", "x", 1), ("a", "TOTAL", 2), ("a", None, 3)], "a string, b string, n int")
    assert [r["n"] for r in m.drop_total_rows(df).collect()] == [3]


def test_noise_aspects(spark):
    df = spark.createDataFrame([("Generic", 1.0), ("Price", None), ("Price", 2.0), (None, 3.0)], "ASPECT string, ASPECT_SENTIMENT double")
    assert [tuple(r) for r in m.drop_noise_aspects(df).collect()] == [("Price", 2.0), (None, 3.0)]


def test_folded_contains_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).select(F.upper(F.concat(F.lit("brand#"), F.col("id").cast("string"))).alias("name")).write.parquet(path)
    plan = spark.read.parquet(path).filter(m.ci_contains("name", "brand#2", folded=True))._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(name,BRAND#2)" in plan
