"""Derived and display columns over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions import formatting as fmt, scoring
from reviewlens.operators import compare, measures, sales as sell, tables
from reviewlens.plans.oracle import NS
from reviewlens.plans.registry import query
from reviewlens.sources import bindings as bind

_BY_FAMILY = f"SELECT Product_Family, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews GROUP BY Product_Family"


def _by_family(spark, d):
    return measures.net_sentiment(bind.reviews(spark, d, "Product_Family", "Sentiment_Score"), "Product_Family")


@query("prj1_sentiment_score", """SELECT Sentiment, CAST(sum(Sentiment_Score) AS BIGINT) AS SENTIMENT_MARK, count(*) AS REVIEW_COUNT
FROM (SELECT Sentiment, CASE Sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS Sentiment_Score
      FROM text_reviews) GROUP BY Sentiment""", "text_reviews")
def _(spark, d):
    scored = scoring.with_score(bind.text_reviews(spark, d).select("Sentiment"))
    return scored.groupBy("Sentiment").agg(
        F.sum("Sentiment_Score").alias("SENTIMENT_MARK"), F.count(F.lit(1)).alias("REVIEW_COUNT"))


@query("prj2_review_count_column", "SELECT Sentiment, CAST(count(*) AS DOUBLE) AS REVIEW_COUNT FROM reviews GROUP BY Sentiment",
       "reviews")
def _(spark, d):
    counted = scoring.with_review_count(bind.reviews(spark, d, "Sentiment"))
    return counted.groupBy("Sentiment").agg(F.sum("Review_Count").alias("REVIEW_COUNT"))


@query("prj3_normalized_keys", """SELECT p_partkey, upper(p_brand) AS Product,
  upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' '
  || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS Keywords FROM part""")
def _(spark, d):
    parts = bind.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("Product"), F.col("p_name").alias("Keywords"))
    return fmt.normalize_keys(parts)


@query("prj4_filled_unknown", """SELECT coalesce(CAST(l.quality AS VARCHAR), 'Unknown') AS QUALITY, count(*) AS REVIEW_COUNT
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def _(spark, d):
    marks = bind.table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("QUALITY"))
    joined = bind.table(spark, d, "documents").select("doc_id").join(marks, "doc_id", "left")
    return fmt.fill_unknown(joined).groupBy("QUALITY").agg(F.count(F.lit(1)).alias("REVIEW_COUNT"))


@query("prj5_upper_columns", """SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME, c_nationkey AS C_NATIONKEY,
  c_acctbal AS C_ACCTBAL, c_mktsegment AS C_MKTSEGMENT FROM customer""")
def _(spark, d):
    return fmt.upper_columns(bind.table(spark, d, "customer"))


@query("prj6_rounded", f"SELECT Product_Family, round_even(NET_SENTIMENT * 10, 0) / 10 AS NET_SENTIMENT, REVIEW_COUNT FROM ({_BY_FAMILY})",
       "reviews")
def _(spark, d):
    return fmt.round_numeric(_by_family(spark, d))


@query("prj7_impact", f"""SELECT Product_Family, NET_SENTIMENT, REVIEW_COUNT,
  CASE WHEN own < bar THEN 'LOW' WHEN own = bar THEN ' ' ELSE 'HIGH' END AS Impact
FROM (SELECT *, round_even(NET_SENTIMENT * 10, 0) / 10 AS own,
        (SELECT round_even({NS} * 10, 0) / 10 FROM reviews) AS bar FROM ({_BY_FAMILY}))""", "reviews")
def _(spark, d):
    overall = measures.net_sentiment(bind.reviews(spark, d, "Sentiment_Score")).select("NET_SENTIMENT").scalar()
    return fmt.with_impact(_by_family(spark, d), overall)


@query("prj8_star_rating", f"""SELECT Product_Family, CAST(floor(s) AS INT) AS FULL_STARS,
  CASE WHEN s - floor(s) >= 0.5 THEN 1 ELSE 0 END AS HALF_STARS,
  5 - CAST(floor(s) AS INT) - CASE WHEN s - floor(s) >= 0.5 THEN 1 ELSE 0 END AS EMPTY_STARS
FROM (SELECT Product_Family, (NET_SENTIMENT + 100) / 40 AS s FROM ({_BY_FAMILY}))""", "reviews")
def _(spark, d):
    rated = _by_family(spark, d).select("Product_Family", fmt.star_rating("NET_SENTIMENT").alias("s"))
    return rated.select("Product_Family", F.col("s.full").alias("FULL_STARS"), F.col("s.half").alias("HALF_STARS"),
                        F.col("s.empty").alias("EMPTY_STARS"))


def _heat_sql(value: str) -> str:
    place = f"((({value}) - (-100.0)) / 200 * 2 - 1)"
    channels = ", ".join(
        f"CAST(trunc(CASE WHEN {place} <= 0 THEN ({place} + 1) * {float(m - lo)} + {float(lo)} "
        f"ELSE {place} * {float(hi - m)} + {float(m)} END) AS INT)"
        for lo, m, hi in ((0xB0, 0xDC, 0x34), (0x34, 0xDC, 0x7C), (0x3C, 0xDC, 0x47)))
    return f"printf('#%02x%02x%02x', {channels})"


@query("prj9_heat_color", f"""SELECT Product_Family, {_heat_sql('NET_SENTIMENT')} AS HEAT,
  {_heat_sql('trunc(NET_SENTIMENT)')} AS HEAT_TRUNCATED FROM ({_BY_FAMILY})""", "reviews")
def _(spark, d):
    return _by_family(spark, d).select(
        "Product_Family", fmt.heat_color("NET_SENTIMENT").alias("HEAT"),
        fmt.heat_color("NET_SENTIMENT", truncate=True).alias("HEAT_TRUNCATED"))


@query("prj10_unit_labels", """SELECT Series, CAST(CAST(round_even(CAST(sum(Sales_Units) AS DOUBLE) / 1000, 0) AS BIGINT) AS VARCHAR) || 'K' AS UNITS,
  '$' || CAST(CAST(round_even(CAST(sum(Sales_Value) AS DOUBLE) / sum(Sales_Units), 0) AS BIGINT) AS VARCHAR) AS PRICE
FROM sales GROUP BY Series""", "sales")
def _(spark, d):
    figures = bind.sales(spark, d, "Series", "Sales_Units", "Sales_Value").groupBy("Series").agg(
        sell.thousands(F.sum("Sales_Units")).alias("units"), sell.price_of().alias("price"))
    return figures.select("Series", fmt.fmt_thousands("units").alias("UNITS"), fmt.fmt_usd("price").alias("PRICE"))


@query("prj11_parsed_count", "SELECT Product_Family, count(*) * 1000 AS REVIEW_COUNT FROM reviews GROUP BY Product_Family", "reviews")
def _(spark, d):
    shown = measures.review_count(bind.reviews(spark, d, "Product_Family"), "Product_Family").select(
        "Product_Family", F.format_number(F.col("REVIEW_COUNT") * 1000, 0).alias("text"))
    return shown.select("Product_Family", fmt.parse_count("text").alias("REVIEW_COUNT"))


@query("prj12_display_name", "SELECT DISTINCT Series, upper(OEMGROUP) || ' ' || Series AS DISPLAY_NAME FROM sales", "sales")
def _(spark, d):
    pairs = bind.sales(spark, d, "OEMGROUP", "Series").distinct()
    return pairs.select("Series", fmt.display_name("OEMGROUP", "Series").alias("DISPLAY_NAME"))


@query("prj13_parsed_month", "SELECT Month AS MONTH_DATE, strftime(Month, '%Y-%m-%d') AS MONTH_TEXT, count(*) AS SALES_ROWS FROM sales GROUP BY Month",
       "sales")
def _(spark, d):
    months = bind.sales(spark, d, "Month_Text").groupBy(fmt.parse_month("Month_Text").alias("MONTH_DATE")).agg(
        F.count(F.lit(1)).alias("SALES_ROWS"))
    return months.withColumn("MONTH_TEXT", fmt.format_day("MONTH_DATE"))


@query("prj14_year_and_month", "SELECT strftime(Month, '%Y') AS YEAR, strftime(Month, '%m') AS MONTH, count(*) AS SALES_ROWS FROM sales GROUP BY 1, 2",
       "sales")
def _(spark, d):
    return bind.sales(spark, d, "Month_Text").groupBy(
        fmt.year_of("Month_Text").alias("YEAR"), fmt.month_of("Month_Text").alias("MONTH")).agg(
        F.count(F.lit(1)).alias("SALES_ROWS"))


@query("prj15_review_percentage", f"""SELECT ASPECT, ASPECT_SENTIMENT, REVIEW_COUNT,
  CAST(REVIEW_COUNT AS DOUBLE) * 100 / (SELECT count(*) FROM reviews) AS REVIEW_PERCENTAGE
FROM (SELECT 'TOTAL' AS ASPECT, round({NS} * 10) / 10 AS ASPECT_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews
      UNION ALL SELECT Aspect, round({NS} * 10) / 10, count(*) FROM reviews GROUP BY Aspect)""", "reviews")
def _(spark, d):
    summary = measures.aspect_summary(bind.reviews(spark, d, "Aspect", "Sentiment_Score"))
    return measures.with_review_percentage(summary)


@query("prj16_whole_numbers", f"SELECT Product_Family, CAST(trunc(NET_SENTIMENT) AS BIGINT) AS NET_SENTIMENT, REVIEW_COUNT FROM ({_BY_FAMILY})",
       "reviews")
def _(spark, d):
    return fmt.to_int(_by_family(spark, d))


@query("prj17_tagged", f"SELECT 'OVERALL' AS ASPECT, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews", "reviews")
def _(spark, d):
    return fmt.tag(measures.net_sentiment(bind.reviews(spark, d, "Sentiment_Score")), ASPECT="OVERALL")


@query("prj18_presentation", f"""SELECT PRODUCT_FAMILY, ASPECT, round_even(n * 10, 0) / 10 AS NET_SENTIMENT_ASPECT
FROM (SELECT Product_Family AS PRODUCT_FAMILY, Aspect AS ASPECT, {NS} AS n FROM reviews GROUP BY 1, 2
      UNION ALL SELECT Product_Family, 'OVERALL', {NS} FROM reviews GROUP BY 1)""", "reviews")
def _(spark, d):
    table = compare.compare_families(bind.reviews(spark, d, "Product_Family", "Aspect", "Sentiment_Score"))
    labelled = table.select(F.lit("reviews").alias("ORIGIN"), "*")
    return tables.presentation_frame(labelled)


@query("prj19_distribution_profile", """SELECT Sentiment AS CATEGORY, CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM reviews) AS VALUE,
  true AS IS_SHARE, false AS IS_NEGATIVE FROM reviews GROUP BY Sentiment""", "reviews")
def _(spark, d):
    return tables.distribution_profile(measures.sentiment_distribution(bind.reviews(spark, d, "Sentiment")))
