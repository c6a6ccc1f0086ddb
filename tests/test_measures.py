import pytest
from pyspark.sql import functions as F

from reviewlens.operators import digest, keywords as kw, measures as ms, tables


def test_net_sentiment(reviews):
    row = ms.net_sentiment(reviews).first()
    assert (row["NET_SENTIMENT"], row["REVIEW_COUNT"]) == (-1 * 100 / 8 + 12.5, 8)


def test_net_sentiment_of_nothing(reviews):
    row = ms.net_sentiment(reviews.filter("false")).first()
    assert row["NET_SENTIMENT"] is None and row["REVIEW_COUNT"] == 0


def test_by_family_most_reviewed_first(reviews):
    got = [tuple(r) for r in ms.net_sentiment(reviews, "Product_Family").collect()]
    assert got == [("P ONE", 20.0, 5), ("Q 100%_A", 0.0, 2), ("P TWO", -100.0, 1)]


def test_two_columns_fewer_values_first(reviews):
    assert ms.net_sentiment_by_two(reviews, "Product_Family", "Product").columns[:2] == ["Product", "Product_Family"]


def test_aspect_summary(reviews):
    got = [tuple(r) for r in ms.aspect_summary(reviews, "p one").collect()]
    assert got == [("TOTAL", 20.0, 5), ("Price", 33.3, 3), (None, 0.0, 1), ("Design", 0.0, 1)]


def test_single_aspect_keeps_overall_total(reviews):
    got = [tuple(r) for r in ms.aspect_summary(reviews, "p one", aspect="price").collect()]
    assert got == [("TOTAL", 20.0, 5), ("Price", 33.3, 3)]


def test_total_by_exact_name(reviews):
    got = {r["ASPECT"]: r["REVIEW_COUNT"] for r in ms.aspect_summary(reviews, "p", total_match="equals").collect()}
    assert got["TOTAL"] is None and got["Price"] == 4


def test_name_with_wildcards_is_literal(reviews):
    assert ms.aspect_summary(reviews, "100%_a").filter("ASPECT = 'TOTAL'").first()["REVIEW_COUNT"] == 2
    assert ms.aspect_summary(reviews, "1%a").count() == 0


def test_aspect_counts_sum_to_total(reviews):
    got = {r["ASPECT"]: r["REVIEW_COUNT"] for r in ms.aspect_summary(reviews).collect()}
    assert got.pop("TOTAL") == sum(got.values()) == 8


def test_ratings_default_to_zero(reviews):
    row = ms.aspect_ratings(reviews, "p one", ("Price", "Battery")).first()
    assert (round(row["Price"], 3), row["Battery"]) == (33.333, 0.0)


@pytest.mark.parametrize("x", ["Aspect", "Geography", "Sentiment"])
def test_distributions_sum_to_hundred(reviews, x):
    assert ms.review_distribution(reviews, x).agg(F.sum("REVIEW_DISTRIBUTION")).first()[0] == pytest.approx(100)


def test_total_row_both_ways(reviews, rows_of):
    asked = [("Product_Family", "p")]
    a = ms.net_sentiment_with_total(reviews, "Geography", asked)
    b = ms.with_total_row(reviews, ms.net_sentiment(reviews, "Geography", asked), asked)
    assert rows_of(a, *sorted(a.columns)) == rows_of(b, *sorted(b.columns))
    assert tuple(a.first())[0] == "TOTAL"


def test_missing_aspect_is_null(reviews):
    row = ms.aspect_ns_wide(reviews, ["p two"], ["Price", "Battery"]).first()
    assert row["Price"] == -100.0 and row["Battery"] is None


def test_keyword_percentages_over_the_aspect(reviews):
    got = {r["Keywords"]: r for r in kw.keyword_stats(reviews, "p one", ["Price"]).collect()}
    cheap = got["Cheap"]
    assert cheap["KEYWORD_CONTRIBUTION"] == pytest.approx(200 / 3) and cheap["POSITIVE_PERCENTAGE"] == pytest.approx(200 / 3)
    assert got["Dear"]["NEGATIVE_PERCENTAGE"] == pytest.approx(100 / 3)


def test_keyword_shares_add_up(reviews):
    stats = kw.keyword_stats(reviews.filter("Sentiment IS NOT NULL"), k=None, by=["Product_Family"])
    for r in stats.collect():
        assert r["POSITIVE_PERCENTAGE"] + r["NEGATIVE_PERCENTAGE"] + r["NEUTRAL_PERCENTAGE"] == pytest.approx(r["KEYWORD_CONTRIBUTION"])


def test_keyword_shares_over_the_term(reviews):
    got = {r["Keywords"]: r for r in kw.keyword_stats(reviews, "p one", ["Price"], base="term").collect()}
    assert got["Cheap"]["POSITIVE_PERCENTAGE"] == 100.0


def test_best_and_worst_keep_ties(spark):
    rows = [("F", "A", t, s) for t, s in (("x", "positive"), ("y", "positive"), ("z", "negative"))]
    df = spark.createDataFrame(rows, "Product_Family string, Aspect string, Aspect_Description string, Sentiment string")
    got = sorted((r["FEATURE"], r["Aspect_Description"]) for r in kw.best_worst_topics(df, "f").collect())
    assert got == [("Most Concerning", "z"), ("Most Preferred", "x"), ("Most Preferred", "y")]


def test_presentation_drops_constant_columns(spark):
    df = spark.createDataFrame([("s", "TOTAL", 1.0, 2.0, 9, "HIGH"), ("s", "a", 1.26, 2.0, 9, "LOW"), ("s", "b", 3.0, 4.0, 9, "LOW")],
                               "src string, name string, x double, y double, REVIEW_COUNT int, Impact string")
    shown = tables.presentation_frame(df)
    assert shown.columns == ["name", "x", "y"] and [tuple(r) for r in shown.collect()] == [("a", 1.3, 2.0), ("b", 3.0, 4.0)]


def test_profile_of_signed_values(spark):
    df = spark.createDataFrame([("a", -5.0), ("b", 20.0)], "k string, v double")
    got = [(r["IS_SHARE"], r["IS_NEGATIVE"]) for r in tables.distribution_profile(df).orderBy("CATEGORY").collect()]
    assert got == [(False, True), (False, False)]


def test_digest_is_nested_and_ordered(reviews):
    rows = digest.review_digest(reviews, ["P ONE"], term_col="Keywords").collect()
    price = next(r for r in rows if r["ASPECT"] == "Price")
    assert [t["TERM"] for t in price["TERMS"]] == ["Cheap", "Dear"]
    assert price["DIRECTION"] == "HIGH" and price["REVIEW_PERCENTAGE"] == 60.0


def test_quantify_marks_rows(reviews):
    got = {r["Product_Family"]: r["Impact"] for r in digest.quantify(reviews, "Product_Family").collect()}
    assert got == {"TOTAL": " ", "P ONE": "HIGH", "Q 100%_A": " ", "P TWO": "LOW"}


def test_pros_cons_and_candidates(reviews):
    sides = {(r["Product_Family"], r["SIDE"]): r["TERM"] for r in digest.pros_cons(reviews).collect()}
    assert sides[("P ONE", "PRO")] == "Cheap" and sides[("P ONE", "CON")] == "Dear"
    worst = digest.improvement_candidates(reviews, 1).filter("Product_Family = 'P TWO'").first()
    assert (worst["TERM"], worst["NEGATIVE_COUNT"]) == ("Dear", 1)


def test_verbatims_of_a_review_with_several_aspects(spark):
    rows = [("P", "Price", "positive", None, "t", "long text"), ("P", "Design", "positive", None, "t", "long text"), ("P", "Price", "positive", None, "u", "short"),
            ("P", "Price", "positive", None, "t", "long text")]
    df = spark.createDataFrame(rows, "Product_Family string, Aspect string, Sentiment string, Review_Date date, Title string, Review string")
    assert sorted((r["Aspect"], r["Review"]) for r in digest.verbatims(df).collect()) == [("Design", "long text"), ("Price", "long text")]


def test_filters_of_all_kinds(reviews):
    from reviewlens.functions.matching import apply_filters
    count = lambda *filters: apply_filters(reviews, filters).count()
    assert count(("Product", "equals", "p")) == 6 and count(("Product", "not", "p")) == 2
    assert count(("Product_Family", "in", ["p one", "p two"])) == 6 and count(("Product_Family", "in", ["p"])) == 0
    assert count(("Aspect", "equals", "unknown")) == 1 and count(("Aspect", "not", "price")) == 4 and count(("Aspect", "pri")) == 4


def test_verbatims_take_the_longest(spark):
    df = spark.createDataFrame([(1, "F", "aa"), (2, "F", "bbb"), (3, "F", "ccc"), (4, "G", "d")], "review_id int, Product_Family string, Review string")
    got = digest.verbatims(df, 1, ["Product_Family"], "review_id").orderBy("Product_Family").collect()
    assert [(r["review_id"], r["PLACE"]) for r in got] == [(2, 1), (4, 1)]


def test_kept_sketches_answer_coarser_questions(spark):
    from reviewlens.operators import measures as ms
    df = spark.range(60000).selectExpr("id % 5 as a", "id % 7 as b", "concat('v', id % 20000) as v", "if(id % 3 = 0, null, id % 4) as small")
    kept = ms.distinct_sketches(df, "v", ["a", "b"])
    assert kept.count() == 35
    assert abs(ms.distinct_of_sketches(kept).first()[0] - 20000) < 0.05 * 20000
    by = {r["a"]: r["DISTINCT_ESTIMATE"] for r in ms.distinct_of_sketches(kept, "a").collect()}
    exact = {r["a"]: r["DISTINCT_COUNT"] for r in ms.count_distinct_of(df, "v", "a").collect()}
    assert by.keys() == exact.keys() and all(abs(by[k] - exact[k]) < 0.06 * exact[k] for k in exact)
    assert ms.distinct_of_sketches(ms.distinct_sketches(df, "small", ["a"])).first()[0] == 4
    assert ms.distinct_of_sketches(ms.distinct_sketches(df.limit(0), "v", ["a"])).collect()[0][0] in (0, None)
