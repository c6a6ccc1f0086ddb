"""Predicates over the whole review and sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions import matching as m
from reviewlens.operators import digest, measures, ranking, tables
from reviewlens.plans.oracle import NS
from reviewlens.plans.registry import query
from reviewlens.sources import bindings as bind


def _counted(sql_filter: str) -> str:
    return f"SELECT Product_Family, count(*) AS REVIEW_COUNT FROM reviews WHERE {sql_filter} GROUP BY Product_Family"


def _families(spark, d, *more):
    return bind.reviews(spark, d, "Product_Family", *more)


def _count(df):
    return measures.review_count(df, "Product_Family")


@query("flt1_contains", _counted("Product_Family LIKE '%BRAND#2%'"), "reviews")
def _(spark, d):
    return _count(_families(spark, d).filter(m.ci_contains("Product_Family", "brand#2", folded=True)))


@query("flt2_equals", _counted("Product_Family = 'BRAND#2 RING'"), "reviews")
def _(spark, d):
    return _count(_families(spark, d).filter(m.ci_equals("Product_Family", "Brand#2 Ring")))


@query("flt3_not_contains", _counted("Product_Family NOT LIKE '%BRAND#2%'"), "reviews")
def _(spark, d):
    return _count(_families(spark, d).filter(~m.ci_contains("Product_Family", "brand#2")))


@query("flt4_in_list", _counted("Product_Family IN ('BRAND#2 RING', 'BRAND#3 BOLT')"), "reviews")
def _(spark, d):
    return _count(_families(spark, d).filter(F.col("Product_Family").isin("BRAND#2 RING", "BRAND#3 BOLT")))


@query("flt5_all_filters", f"SELECT {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews "
       "WHERE Product_Family LIKE '%BRAND#2%' AND Geography LIKE '%NATION_1%'", "reviews")
def _(spark, d):
    rows = _families(spark, d, "Geography", "Sentiment_Score")
    return measures.net_sentiment(m.apply_filters(rows, [("Product_Family", "brand#2"), ("Geography", "nation_1")]))


@query("flt6_any_contains", _counted("Product_Family LIKE '%RING%' OR Product_Family LIKE '%BRAND#3%'"), "reviews")
def _(spark, d):
    return _count(_families(spark, d).filter(m.any_contains("Product_Family", ["ring", "brand#3"])))


@query("flt7_product_aspects", "SELECT * FROM family_aspects WHERE ASPECT_SENTIMENT IS NOT NULL AND "
       "ASPECT NOT IN ('Generic', 'Account', 'Customer-Service', 'Browser')", "family_aspects")
def _(spark, d):
    return m.drop_noise_aspects(digest.family_aspects(_families(spark, d, "Aspect", "Sentiment_Score")))


@query("flt8_rankable_rows", "SELECT * FROM family_aspects WHERE ASPECT_SENTIMENT <> 0 AND ASPECT NOT IN ('Generic', 'TOTAL')",
       "family_aspects")
def _(spark, d):
    return ranking.rankable(digest.family_aspects(_families(spark, d, "Aspect", "Sentiment_Score")))


@query("flt9_without_totals", f"SELECT Geography, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews GROUP BY Geography", "reviews")
def _(spark, d):
    table = measures.net_sentiment_with_total(bind.reviews(spark, d, "Geography", "Sentiment_Score"), "Geography")
    return m.drop_total_rows(table).drop("SORT_KEY")


@query("flt10_valid_sales", "SELECT Series, count(*) AS SALES_ROWS FROM sales WHERE Sales_Units <> 0 AND ASP >= 0 GROUP BY Series", "sales")
def _(spark, d):
    rows = bind.sales(spark, d, "Series", "Sales_Units", "ASP").filter(m.valid_sales())
    return rows.groupBy("Series").agg(F.count(F.lit(1)).alias("SALES_ROWS"))


@query("flt11_one_aspect_with_total", f"""SELECT 'TOTAL' AS ASPECT, round({NS} * 10) / 10 AS ASPECT_SENTIMENT, count(*) AS REVIEW_COUNT
FROM reviews WHERE Product_Family LIKE '%BRAND#2%'
UNION ALL SELECT Aspect, round({NS} * 10) / 10, count(*) FROM reviews
WHERE Product_Family LIKE '%BRAND#2%' AND Aspect LIKE '%Promo%' GROUP BY Aspect""", "reviews")
def _(spark, d):
    rows = _families(spark, d, "Aspect", "Sentiment_Score")
    return measures.aspect_summary(rows, "brand#2", aspect="promo")


@query("flt12_exact_aspect_and_family", """SELECT Keywords, count(*) AS REVIEW_COUNT FROM reviews
WHERE Aspect = 'Promo' AND Product_Family = 'BRAND#2 RING' GROUP BY Keywords""", "reviews")
def _(spark, d):
    rows = _families(spark, d, "Aspect", "Keywords").filter(
        (F.col("Aspect") == "Promo") & (F.col("Product_Family") == "BRAND#2 RING"))
    return measures.review_count(rows, "Keywords")


def _sums(spark, d, word):
    rows = _families(spark, d, "Sentiment_Score").filter(m.ci_contains("Product_Family", word))
    return measures.net_sentiment(rows, "Product_Family")


def _sums_sql(word: str) -> str:
    return (f"SELECT Product_Family, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews "
            f"WHERE Product_Family LIKE '%{word}%' GROUP BY Product_Family")


@query("set1_union_distinct", f"{_sums_sql('RING')} UNION {_sums_sql('BRAND#2')}", "reviews")
def _(spark, d):
    return tables.union_distinct(_sums(spark, d, "ring"), _sums(spark, d, "brand#2"))


@query("set2_union_all", f"{_sums_sql('RING')} UNION ALL {_sums_sql('BRAND#2')}", "reviews")
def _(spark, d):
    return tables.union_all(_sums(spark, d, "ring"), _sums(spark, d, "brand#2"))


@query("set3_stacked", f"SELECT *, 0 AS SORT_KEY FROM ({_sums_sql('RING')}) UNION ALL SELECT *, 1 FROM ({_sums_sql('BOLT')})", "reviews")
def _(spark, d):
    return tables.stack(_sums(spark, d, "ring"), _sums(spark, d, "bolt"))


@query("set4_distinct_values", "SELECT DISTINCT Product_Family FROM reviews", "reviews")
def _(spark, d):
    return tables.distinct_values(_families(spark, d), "Product_Family")
