"""Ranks, normalisation, orders and limits over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import digest, keywords as kw, measures as ms, ranking as rk
from reviewlens.plans.oracle import NS
from reviewlens.plans.registry import query
from reviewlens.sources import bindings as bind


@query("win1_top_k_per_group", """SELECT * FROM (SELECT Aspect, Aspect_Description, n AS REVIEW_COUNT,
  row_number() OVER (PARTITION BY Aspect ORDER BY n DESC, Aspect_Description) AS RANK
  FROM (SELECT Aspect, Aspect_Description, count(*) AS n FROM reviews GROUP BY 1, 2)) WHERE RANK <= 3""", "reviews")
def _(spark, d):
    counts = kw.topic_counts(bind.reviews(spark, d, "Aspect", "Aspect_Description"))
    return rk.top_k_per_group(counts, ["Aspect"], [F.desc("REVIEW_COUNT"), F.asc("Aspect_Description")], 3)


@query("win2_rank_with_ties", """SELECT * FROM (SELECT Country, Month, n AS SALES_UNITS, rank() OVER (PARTITION BY Country ORDER BY n DESC) AS RANK
  FROM (SELECT Country, Month, CAST(max(Sales_Units) AS BIGINT) AS n FROM sales GROUP BY 1, 2)) WHERE RANK <= 1""", "sales")
def _(spark, d):
    peaks = bind.sales(spark, d, "Country", "Month", "Sales_Units").groupBy("Country", "Month").agg(
        F.max("Sales_Units").alias("SALES_UNITS"))
    return rk.rank_top(peaks, ["Country"], [F.desc("SALES_UNITS")])


@query("win3_rank_max", """SELECT Chassis_Segment, Sales_Value, count(*) OVER (PARTITION BY Chassis_Segment ORDER BY Sales_Value DESC NULLS LAST
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS RANK FROM (SELECT Chassis_Segment, CAST(Sales_Value AS DOUBLE) AS Sales_Value FROM sales)""", "sales")
def _(spark, d):
    rows = bind.sales(spark, d, "Chassis_Segment", "Sales_Value").withColumn("Sales_Value", F.col("Sales_Value").cast("double"))
    return rk.rank_max(rows, "Sales_Value", ["Chassis_Segment"])


@query("win4_min_max", """SELECT Chassis_Segment, ASP, (ASP - min(ASP) OVER w) / nullif(max(ASP) OVER w - min(ASP) OVER w, 0) AS NORMALIZED
FROM sales WINDOW w AS (PARTITION BY Chassis_Segment)""", "sales")
def _(spark, d):
    return rk.min_max(bind.sales(spark, d, "Chassis_Segment", "ASP"), "ASP", ["Chassis_Segment"])


@query("win5_recent_history", """SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4""")
def _(spark, d):
    return rk.recent_history(bind.history(spark, d))


def _aspects(spark, d):
    return digest.family_aspects(bind.reviews(spark, d, "Product_Family", "Aspect", "Sentiment_Score"))


@query("rnk1_aspect_ranking", """SELECT PRODUCT_FAMILY, ASPECT, REVIEW_COUNT, ASPECT_SENTIMENT, REVIEW_PERCENTAGE, NET_SENTIMENT,
  ASPECT_RANKING, PLACE FROM ranked_aspects WHERE PLACE <= 4""", "ranked_aspects")
def _(spark, d):
    return rk.aspect_ranking(_aspects(spark, d), ["PRODUCT_FAMILY"])


@query("rnk2_top_aspects_by_count", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY PRODUCT_FAMILY ORDER BY REVIEW_COUNT DESC, ASPECT) AS PLACE
  FROM family_aspects) WHERE PLACE <= 4""", "family_aspects")
def _(spark, d):
    return rk.top_aspects_by_count(_aspects(spark, d), ["PRODUCT_FAMILY"])


@query("srt1_ordered", f"SELECT Product, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews GROUP BY Product", "reviews")
def _(spark, d):
    return rk.order_desc(ms.net_sentiment(bind.reviews(spark, d, "Product", "Sentiment_Score"), "Product"), "NET_SENTIMENT", "Product")


@query("srt2_top_n", f"SELECT Product_Family, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "reviews")
def _(spark, d):
    table = ms.net_sentiment(bind.reviews(spark, d, "Product_Family", "Sentiment_Score"), "Product_Family")
    return rk.top_n(table, 10, "NET_SENTIMENT", "Product_Family")


_VOLUME = """SELECT Product_Family, Aspect, count(*) AS REVIEW_COUNT, CAST(sum(count(*)) OVER (PARTITION BY Aspect) AS BIGINT) AS REVIEW_COUNT_TOTAL
FROM reviews GROUP BY 1, 2"""


@query("srt3_groups_by_volume", _VOLUME, "reviews")
def _(spark, d):
    table = ms.review_count(bind.reviews(spark, d, "Product_Family", "Aspect"), ["Product_Family", "Aspect"])
    return rk.order_groups_by_volume(table, "Aspect")


@query("jn10_group_volume", _VOLUME.replace("PARTITION BY Aspect", "PARTITION BY Product_Family"), "reviews")
def _(spark, d):
    table = ms.review_count(bind.reviews(spark, d, "Product_Family", "Aspect"), ["Product_Family", "Aspect"])
    return rk.order_groups_by_volume(table, "Product_Family")
