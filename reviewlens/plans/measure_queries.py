"""Review measures and keyword statistics over the whole review table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions import matching as m
from reviewlens.operators import keywords as kw, measures as ms
from reviewlens.plans.oracle import NS
from reviewlens.plans.registry import query
from reviewlens.sources import bindings as bind

_R1 = f"round({NS} * 10) / 10"


def _reviews(spark, d, *columns):
    return bind.reviews(spark, d, *columns)


@query("agg1_net_sentiment", f"SELECT {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews", "reviews")
def _(spark, d):
    return ms.net_sentiment(_reviews(spark, d, "Sentiment_Score"))


@query("agg2_net_sentiment_by", f"SELECT Geography, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews GROUP BY Geography", "reviews")
def _(spark, d):
    return ms.net_sentiment(_reviews(spark, d, "Geography", "Sentiment_Score"), "Geography")


@query("agg3_net_sentiment_by_two", f"SELECT Aspect, Geography, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews GROUP BY 1, 2", "reviews")
def _(spark, d):
    return ms.net_sentiment_by_two(_reviews(spark, d, "Geography", "Aspect", "Sentiment_Score"), "Geography", "Aspect")


@query("agg4_filtered_net_sentiment", f"SELECT {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews WHERE Geography LIKE '%NATION_1%'", "reviews")
def _(spark, d):
    return ms.net_sentiment(_reviews(spark, d, "Geography", "Sentiment_Score"), filters=[("Geography", "nation_1")])


@query("agg5_sentiment_mark", "SELECT Geography, CAST(sum(Sentiment_Score) AS BIGINT) AS SENTIMENT_MARK FROM reviews GROUP BY Geography", "reviews")
def _(spark, d):
    return ms.sentiment_mark(_reviews(spark, d, "Geography", "Sentiment_Score"), "Geography")


@query("agg5_top_by_mark", "SELECT Geography, CAST(sum(Sentiment_Score) AS BIGINT) AS SENTIMENT_MARK FROM reviews GROUP BY Geography ORDER BY 2 DESC, 1 LIMIT 1", "reviews")
def _(spark, d):
    return ms.top_by_mark(_reviews(spark, d, "Geography", "Sentiment_Score"))


@query("agg6_review_count", "SELECT count(*) AS REVIEW_COUNT FROM reviews", "reviews")
def _(spark, d):
    return ms.review_count(_reviews(spark, d, "Sentiment"))


@query("agg7_count_by", "SELECT Product, count(Keywords) AS VALUE_COUNT FROM reviews GROUP BY Product", "reviews")
def _(spark, d):
    return ms.count_of(_reviews(spark, d, "Product", "Keywords"), "Keywords", "Product")


@query("agg8_distinct_count", "SELECT count(DISTINCT Product_Family) AS DISTINCT_COUNT FROM reviews", "reviews")
def _(spark, d):
    return ms.count_distinct_of(_reviews(spark, d, "Product_Family"), "Product_Family")


@query("agg8_distinct_count_by", "SELECT Geography, count(DISTINCT Product_Family) AS DISTINCT_COUNT FROM reviews GROUP BY Geography", "reviews")
def _(spark, d):
    return ms.count_distinct_of(_reviews(spark, d, "Geography", "Product_Family"), "Product_Family", "Geography")


@query("agg8_distinct_count_sketched", """SELECT Geography, count(DISTINCT Aspect_Description) AS DISTINCT_COUNT, true AS WITHIN_FIVE_PERCENT
FROM reviews GROUP BY Geography""", "reviews")
def _(spark, d):
    """Sketches kept by family and geography, merged by geography, beside the exact count."""
    rows = _reviews(spark, d, "Geography", "Product_Family", "Aspect_Description")
    kept = ms.distinct_sketches(rows, "Aspect_Description", ["Product_Family", "Geography"])
    exact = ms.count_distinct_of(rows, "Aspect_Description", "Geography").withColumnRenamed("Geography", "_of")
    joined = ms.distinct_of_sketches(kept, "Geography").join(exact, F.col("Geography").eqNullSafe(F.col("_of")))
    near = F.abs(F.col("DISTINCT_ESTIMATE") - F.col("DISTINCT_COUNT")) <= 0.05 * F.col("DISTINCT_COUNT")
    return joined.select("Geography", "DISTINCT_COUNT", near.alias("WITHIN_FIVE_PERCENT"))


def _summary_sql(total: str, detail: str) -> str:
    return (f"SELECT 'TOTAL' AS ASPECT, {_R1} AS ASPECT_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews WHERE {total} "
            f"UNION ALL SELECT Aspect, {_R1}, count(*) FROM reviews WHERE {detail} GROUP BY Aspect")


@query("agg9_aspect_summary", _summary_sql("Product_Family LIKE '%BRAND#2%'", "Product_Family LIKE '%BRAND#2%'"), "reviews")
def _(spark, d):
    return ms.aspect_summary(_reviews(spark, d, "Product_Family", "Aspect", "Sentiment_Score"), "brand#2")


@query("agg9_filtered_aspect_summary", _summary_sql(
    "Product_Family LIKE '%BRAND#2%' AND Geography LIKE '%NATION_1%'",
    "Product_Family LIKE '%BRAND#2%' AND Geography LIKE '%NATION_1%'"), "reviews")
def _(spark, d):
    rows = _reviews(spark, d, "Product_Family", "Aspect", "Geography", "Sentiment_Score")
    return ms.aspect_summary(rows, "brand#2", [("Geography", "nation_1")])


@query("agg10_exact_total", _summary_sql("Product = 'BRAND#2'", "Product LIKE '%BRAND#2%'"), "reviews")
def _(spark, d):
    rows = _reviews(spark, d, "Product", "Aspect", "Sentiment_Score")
    return ms.aspect_summary(rows, "brand#2", total_match="equals", family_col="Product")


@query("agg11_aspect_ratings", "SELECT Product_Family, " + ", ".join(
    f"""coalesce(CAST(sum(Sentiment_Score) FILTER (WHERE Aspect = '{a}') AS DOUBLE) * 100
    / nullif(count(*) FILTER (WHERE Aspect = '{a}'), 0), 0) AS "{a}" """ for a in ("Promo", "Small", "Economy", "Battery"))
    + "FROM reviews GROUP BY Product_Family", "reviews")
def _(spark, d):
    rows = _reviews(spark, d, "Product_Family", "Aspect", "Sentiment_Score")
    return ms.aspect_ratings(rows, aspects=("Promo", "Small", "Economy", "Battery"), by=["Product_Family"])


@query("agg12_review_distribution", "SELECT Data_Source, CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM reviews) AS REVIEW_DISTRIBUTION FROM reviews GROUP BY 1", "reviews")
def _(spark, d):
    return ms.review_distribution(_reviews(spark, d, "Data_Source"), "Data_Source")


@query("agg13_measure_distribution", "SELECT Country, CAST(sum(Sales_Units) AS DOUBLE) * 100 / (SELECT sum(Sales_Units) FROM sales) AS DISTRIBUTION_PCT FROM sales GROUP BY 1", "sales")
def _(spark, d):
    return ms.measure_distribution(bind.sales(spark, d, "Country", "Sales_Units"), "Sales_Units", "Country")


@query("agg14_sentiment_distribution", "SELECT Sentiment, CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM reviews) AS TOTAL_REVIEWS FROM reviews GROUP BY 1", "reviews")
def _(spark, d):
    return ms.sentiment_distribution(_reviews(spark, d, "Sentiment"))


@query("agg15_review_mix", """SELECT Aspect, CAST(count(*) AS DOUBLE) * 100
  / (SELECT count(*) FROM reviews WHERE Product_Family LIKE '%BRAND#2%') AS REVIEW_COUNT_PERCENTAGE
FROM reviews WHERE Product_Family LIKE '%BRAND#2%' GROUP BY Aspect""", "reviews")
def _(spark, d):
    return ms.review_mix(_reviews(spark, d, "Product_Family", "Aspect"), "brand#2")


_WITH_TOTAL = f"""SELECT 'TOTAL' AS Geography, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT, 0 AS SORT_KEY
FROM reviews WHERE Product_Family LIKE '%BRAND#2%'
UNION ALL SELECT Geography, {NS}, count(*), 1 FROM reviews WHERE Product_Family LIKE '%BRAND#2%' GROUP BY Geography"""


@query("agg16_with_total", _WITH_TOTAL, "reviews")
def _(spark, d):
    rows = _reviews(spark, d, "Product_Family", "Geography", "Sentiment_Score")
    return ms.net_sentiment_with_total(rows, "Geography", [("Product_Family", "brand#2")])


@query("agg16_total_prepended", _WITH_TOTAL, "reviews")
def _(spark, d):
    rows = _reviews(spark, d, "Product_Family", "Geography", "Sentiment_Score")
    asked = [("Product_Family", "brand#2")]
    return ms.with_total_row(rows, ms.net_sentiment(rows, "Geography", asked), asked)


_THREE = ("BRAND#2 RING", "BRAND#3 BOLT", "BRAND#4 GEAR")
_ANY = " OR ".join(f"Product_Family LIKE '%{f}%'" for f in _THREE)


@query("agg17_aspects_wide", "SELECT Product_Family, " + ", ".join(
    f"""CAST(sum(CASE WHEN Aspect = '{a}' THEN Sentiment_Score ELSE 0 END) AS DOUBLE) * 100
    / nullif(sum(CASE WHEN Aspect = '{a}' THEN 1 ELSE 0 END), 0) AS "{a}" """ for a in ("Promo", "Small", "Battery"))
    + f"FROM reviews WHERE {_ANY} GROUP BY Product_Family", "reviews")
def _(spark, d):
    return ms.aspect_ns_wide(_reviews(spark, d, "Product_Family", "Aspect", "Sentiment_Score"), _THREE, ["Promo", "Small", "Battery"])


@query("agg17_aspects_long", " UNION ALL ".join(
    f"""SELECT Product_Family, '{a}' AS ASPECT, CAST(sum(CASE WHEN Aspect = '{a}' THEN Sentiment_Score ELSE 0 END) AS DOUBLE) * 100
    / nullif(sum(CASE WHEN Aspect = '{a}' THEN 1 ELSE 0 END), 0) AS NET_SENTIMENT
    FROM reviews WHERE {_ANY} GROUP BY Product_Family""" for a in ("Promo", "Battery")), "reviews")
def _(spark, d):
    return ms.aspect_ns_long(_reviews(spark, d, "Product_Family", "Aspect", "Sentiment_Score"), _THREE, ["Promo", "Battery"])


@query("agg18_one_aspect", f"SELECT Product_Family, {NS} AS NET_SENTIMENT, 'Promo' AS ASPECT FROM reviews WHERE ({_ANY}) AND Aspect = 'Promo' GROUP BY Product_Family", "reviews")
def _(spark, d):
    return ms.compare_one_aspect(_reviews(spark, d, "Product_Family", "Aspect", "Sentiment_Score"), _THREE, "Promo")


@query("agg19_set_net_sentiment", f"SELECT Aspect, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews WHERE Product_Family IN {_THREE} GROUP BY Aspect", "reviews")
def _(spark, d):
    return ms.set_net_sentiment(_reviews(spark, d, "Product_Family", "Aspect", "Sentiment_Score"), _THREE)


@query("agg20_review_count_by", "SELECT Data_Source, count(*) AS REVIEW_COUNT FROM reviews GROUP BY 1", "reviews")
def _(spark, d):
    return ms.review_count(_reviews(spark, d, "Data_Source"), "Data_Source")


@query("agg20_top_by_count", "SELECT Product_Family, count(*) AS REVIEW_COUNT FROM reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", "reviews")
def _(spark, d):
    return ms.top_by_count(_reviews(spark, d, "Product_Family"), "Product_Family")


@query("agg21_trend", f"SELECT CAST(date_trunc('month', Review_Date) AS DATE) AS PERIOD, Product, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews GROUP BY 1, 2", "reviews")
def _(spark, d):
    return ms.trend(_reviews(spark, d, "Review_Date", "Product", "Sentiment_Score"), "month", "Product")


def _term_sql(term: str) -> str:
    return f"""SELECT Aspect, term AS {term}, CAST(pos AS DOUBLE) * 100 / whole AS POSITIVE_PERCENTAGE,
  CAST(neg AS DOUBLE) * 100 / whole AS NEGATIVE_PERCENTAGE, CAST(neu AS DOUBLE) * 100 / whole AS NEUTRAL_PERCENTAGE,
  CAST(n AS DOUBLE) * 100 / whole AS KEYWORD_CONTRIBUTION
FROM (SELECT *, sum(n) OVER (PARTITION BY Aspect) AS whole,
        row_number() OVER (PARTITION BY Aspect ORDER BY n DESC, term) AS place
  FROM (SELECT Aspect, {term} AS term, count(*) AS n, count(*) FILTER (WHERE Sentiment = 'positive') AS pos,
      count(*) FILTER (WHERE Sentiment = 'negative') AS neg, count(*) FILTER (WHERE Sentiment = 'neutral') AS neu
    FROM reviews WHERE Product_Family LIKE '%BRAND#2%' GROUP BY 1, 2)) WHERE place <= 2"""


@query("key1_keyword_stats", _term_sql("Keywords"), "reviews")
def _(spark, d):
    return kw.keyword_stats(_reviews(spark, d, "Product_Family", "Aspect", "Keywords", "Sentiment"), "brand#2")


@query("key1_keyword_stats_all_families", """SELECT family AS Product_Family, Aspect, term AS Keywords, POSITIVE_PERCENTAGE,
  NEGATIVE_PERCENTAGE, NEUTRAL_PERCENTAGE, KEYWORD_CONTRIBUTION FROM keyword_stats WHERE place <= 2""", "keyword_stats")
def _(spark, d):
    rows = _reviews(spark, d, "Product_Family", "Aspect", "Keywords", "Sentiment")
    return kw.keyword_stats(rows, by=["Product_Family"])


@query("key2_topic_stats", _term_sql("Aspect_Description"), "reviews")
def _(spark, d):
    rows = _reviews(spark, d, "Product_Family", "Aspect", "Aspect_Description", "Sentiment")
    return kw.keyword_stats(rows, "brand#2", term_col="Aspect_Description")


@query("key3_top_keywords", """SELECT Keywords, count(*) AS REVIEW_COUNT,
  CAST(count(*) FILTER (WHERE Sentiment = 'positive') AS DOUBLE) * 100 / count(*) AS POSITIVE_PERCENTAGE,
  CAST(count(*) FILTER (WHERE Sentiment = 'negative') AS DOUBLE) * 100 / count(*) AS NEGATIVE_PERCENTAGE,
  CAST(count(*) FILTER (WHERE Sentiment = 'neutral') AS DOUBLE) * 100 / count(*) AS NEUTRAL_PERCENTAGE
FROM reviews GROUP BY Keywords ORDER BY 2 DESC, 1 LIMIT 10""", "reviews")
def _(spark, d):
    return kw.top_keywords(_reviews(spark, d, "Keywords", "Sentiment"))


@query("key4_keyword_net_sentiment", f"""SELECT Product_Family, Keywords, {NS} AS NET_SENTIMENT_KEYWORDS, count(*) AS REVIEW_COUNT
FROM reviews WHERE Aspect = 'Economy' GROUP BY 1, 2""", "reviews")
def _(spark, d):
    return kw.keyword_net_sentiment(_reviews(spark, d, "Product_Family", "Aspect", "Keywords", "Sentiment_Score"), "Economy")


@query("key5_aspect_topics", "SELECT DISTINCT Aspect, Aspect_Description FROM reviews", "reviews")
def _(spark, d):
    return kw.aspect_topics(_reviews(spark, d, "Aspect", "Aspect_Description"))


@query("key6_topic_counts", "SELECT Aspect, Aspect_Description, count(*) AS REVIEW_COUNT FROM reviews WHERE Product_Family LIKE '%BRAND#2%' GROUP BY 1, 2", "reviews")
def _(spark, d):
    return kw.topic_counts(_reviews(spark, d, "Product_Family", "Aspect", "Aspect_Description"), "brand#2")


@query("key7_best_worst_topics", " UNION ALL ".join(
    f"""SELECT '{feature}' AS FEATURE, Aspect, Aspect_Description, n AS REVIEW_COUNT
    FROM (SELECT *, rank() OVER (PARTITION BY Aspect ORDER BY n DESC) AS r
      FROM (SELECT Aspect, Aspect_Description, count(*) AS n FROM reviews
            WHERE Product_Family LIKE '%BRAND#2%' AND Sentiment = '{label}' GROUP BY 1, 2)) WHERE r = 1"""
    for feature, label in (("Most Preferred", "positive"), ("Most Concerning", "negative"))), "reviews")
def _(spark, d):
    return kw.best_worst_topics(_reviews(spark, d, "Product_Family", "Aspect", "Aspect_Description", "Sentiment"), "brand#2")
