"""Profiles and digests of every device and family at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import digest as dg, names as nm, profile as pf
from reviewlens.plans.oracle import NS
from reviewlens.plans.registry import query
from reviewlens.sources import bindings as bind
from reviewlens.sources.storage import cut_lineage

_RATED = ("Promo", "Small", "Battery")

_PROFILE = f"""SELECT l.DEVICE, NET_SENTIMENT, l.REVIEW_COUNT, {', '.join(f'RATING_{a.upper()}' for a in _RATED)},
  s.SALES_UNITS_K, s.ASP, t.TOP_SPECS, t.TOP_SPECS_UNITS_K, s.FIRST_MONTH, s.LAST_MONTH
FROM (SELECT SalesDevice AS DEVICE, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT, {', '.join(
    f"coalesce(CAST(sum(Sentiment_Score) FILTER (WHERE Aspect = '{a}') AS DOUBLE) * 100 / nullif(count(*) FILTER (WHERE Aspect = '{a}'), 0), 0) AS RATING_{a.upper()}"
    for a in _RATED)}
  FROM reviews JOIN name_mapping ON Product_Family = SentimentDevice GROUP BY 1) l
JOIN (SELECT Series, CAST(sum(Sales_Units) AS DOUBLE) / 1000 AS SALES_UNITS_K, CAST(sum(Sales_Value) AS DOUBLE) / sum(Sales_Units) AS ASP,
    min(Month) AS FIRST_MONTH, max(Month) AS LAST_MONTH FROM sales GROUP BY 1) s ON s.Series = l.DEVICE
JOIN (SELECT Series, Specs_Combination AS TOP_SPECS, u AS TOP_SPECS_UNITS_K,
    row_number() OVER (PARTITION BY Series ORDER BY u DESC, Specs_Combination) AS r
  FROM (SELECT Series, Specs_Combination, CAST(sum(Sales_Units) AS DOUBLE) / 1000 AS u FROM sales GROUP BY 1, 2)) t
  ON t.Series = l.DEVICE AND t.r = 1"""

_STARS = """CAST(floor((NET_SENTIMENT + 100) / 40) AS INT) AS FULL_STARS,
  CASE WHEN (NET_SENTIMENT + 100) / 40 - floor((NET_SENTIMENT + 100) / 40) >= 0.5 THEN 1 ELSE 0 END AS HALF_STARS"""


def _profiles(spark, d):
    return pf.device_profile(
        bind.reviews(spark, d, "Product_Family", "Aspect", "Sentiment_Score"),
        bind.sales(spark, d, "Series", "Specs_Combination", "Sales_Units", "Sales_Value", "Month"),
        bind.name_mapping(spark, d), _RATED)


def _flat_stars(df):
    return df.withColumns({"FULL_STARS": F.col("STARS.full"), "HALF_STARS": F.col("STARS.half")}).drop("STARS")


@query("prf1_device_profile", f"SELECT *, {_STARS} FROM ({_PROFILE})", ("reviews", "sales", "name_mapping"))
def _(spark, d):
    return _flat_stars(_profiles(spark, d))


def _cards(spark, d):
    return pf.competitor_cards(
        bind.reviews(spark, d, "Product_Family", "Sentiment_Score"),
        bind.sales(spark, d, "Series", "Chassis_Segment", "OEMGROUP", "Sales_Units", "Sales_Value", "Month"),
        bind.name_mapping(spark, d))


_CARDS = f"""SELECT n.FOCAL_SERIES, n.RANK, n.Series, a.oem || ' ' || n.Series AS DISPLAY_NAME, n.SALES_UNITS_K, n.COMPETITOR_ASP,
  l.NET_SENTIMENT, a.FIRST_MONTH, a.LAST_MONTH
FROM nearest n JOIN (SELECT Series, min(upper(OEMGROUP)) AS oem, min(Month) AS FIRST_MONTH, max(Month) AS LAST_MONTH FROM sales GROUP BY 1) a
  ON a.Series = n.Series
LEFT JOIN (SELECT SalesDevice, {NS} AS NET_SENTIMENT FROM reviews JOIN name_mapping ON Product_Family = SentimentDevice GROUP BY 1) l
  ON l.SalesDevice = n.Series WHERE n.RANK <= 3"""


@query("prf2_competitor_cards", f"SELECT *, {_STARS} FROM ({_CARDS})", ("reviews", "sales", "name_mapping", "nearest"))
def _(spark, d):
    return _flat_stars(_cards(spark, d))


@query("jn9_competitor_enrichment", f"SELECT FOCAL_SERIES, Series, SALES_UNITS_K, COMPETITOR_ASP, NET_SENTIMENT FROM ({_CARDS})",
       ("reviews", "sales", "name_mapping", "nearest"))
def _(spark, d):
    return _cards(spark, d).select("FOCAL_SERIES", "Series", "SALES_UNITS_K", "COMPETITOR_ASP", "NET_SENTIMENT")


_MEASURED = ("NET_SENTIMENT", "REVIEW_COUNT", "SALES_UNITS_K", "ASP", "TOP_SPECS", "FIRST_MONTH")


def _beside(column: str) -> str:
    # Whole and fractional figures print differently in the two engines; compare them as numbers.
    if column in ("TOP_SPECS", "FIRST_MONTH"):
        return f"SELECT '{column}' AS MEASURE, CAST(a.{column} AS VARCHAR) AS FIRST, CAST(b.{column} AS VARCHAR) AS SECOND"
    return (f"SELECT '{column}' AS MEASURE, CAST(CAST(round(a.{column} * 1000) AS BIGINT) AS VARCHAR) AS FIRST, "
            f"CAST(CAST(round(b.{column} * 1000) AS BIGINT) AS VARCHAR) AS SECOND")


@query("prf3_side_by_side", " UNION ALL ".join(
    f"{_beside(c)} FROM (SELECT * FROM ({_PROFILE}) WHERE DEVICE = 'BRAND#2') a, (SELECT * FROM ({_PROFILE}) WHERE DEVICE = 'BRAND#3') b"
    for c in _MEASURED), ("reviews", "sales", "name_mapping"))
def _(spark, d):
    return _shown(pf.side_by_side(_profiles(spark, d).select("DEVICE", "STARS", *_MEASURED), "BRAND#2", "BRAND#3"))


def _shown(beside):
    whole = ~F.col("MEASURE").isin("TOP_SPECS", "FIRST_MONTH")

    def shown(c: str):
        return F.when(whole, F.round(F.col(c).try_cast("double") * 1000).cast("long").cast("string")).otherwise(F.col(c))

    return beside.select("MEASURE", shown("FIRST").alias("FIRST"), shown("SECOND").alias("SECOND"))


_SETS = "SELECT DISTINCT split_part(SentimentDevice, ' ', 2) AS DEVICE, SentimentDevice, SalesDevice FROM name_mapping"

_SET_PROFILE = f"""SELECT l.DEVICE, NET_SENTIMENT, l.REVIEW_COUNT, {', '.join(f'RATING_{a.upper()}' for a in _RATED)},
  s.SALES_UNITS_K, s.ASP, t.TOP_SPECS, t.TOP_SPECS_UNITS_K, s.FIRST_MONTH, s.LAST_MONTH
FROM (SELECT DEVICE, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT, {', '.join(
    f"coalesce(CAST(sum(Sentiment_Score) FILTER (WHERE Aspect = '{a}') AS DOUBLE) * 100 / nullif(count(*) FILTER (WHERE Aspect = '{a}'), 0), 0) AS RATING_{a.upper()}"
    for a in _RATED)}
  FROM reviews JOIN (SELECT DISTINCT DEVICE, SentimentDevice FROM ({_SETS})) ON Product_Family = SentimentDevice GROUP BY 1) l
JOIN (SELECT DEVICE, CAST(sum(Sales_Units) AS DOUBLE) / 1000 AS SALES_UNITS_K, CAST(sum(Sales_Value) AS DOUBLE) / sum(Sales_Units) AS ASP,
    min(Month) AS FIRST_MONTH, max(Month) AS LAST_MONTH
  FROM sales JOIN (SELECT DISTINCT DEVICE, SalesDevice FROM ({_SETS})) ON Series = SalesDevice GROUP BY 1) s USING (DEVICE)
JOIN (SELECT DEVICE, Specs_Combination AS TOP_SPECS, u AS TOP_SPECS_UNITS_K,
    row_number() OVER (PARTITION BY DEVICE ORDER BY u DESC, Specs_Combination) AS r
  FROM (SELECT DEVICE, Specs_Combination, CAST(sum(Sales_Units) AS DOUBLE) / 1000 AS u
    FROM sales JOIN (SELECT DISTINCT DEVICE, SalesDevice FROM ({_SETS})) ON Series = SalesDevice GROUP BY 1, 2)) t
  ON t.DEVICE = l.DEVICE AND t.r = 1"""


def _set_profiles(spark, d):
    """All families by one noun, whoever sells them, as one device."""
    mapping = bind.name_mapping(spark, d)
    stated = mapping.select(F.split_part("SentimentDevice", F.lit(" "), F.lit(2)).alias("DEVICE"), F.col("SentimentDevice").alias("NAME"))
    return pf.set_profile(
        bind.reviews(spark, d, "Product_Family", "Aspect", "Sentiment_Score"),
        bind.sales(spark, d, "Series", "Specs_Combination", "Sales_Units", "Sales_Value", "Month"),
        nm.sets_of_names(stated, mapping), _RATED)


@query("prf1_profile_of_name_set", f"SELECT *, {_STARS} FROM ({_SET_PROFILE})", ("reviews", "sales", "name_mapping"))
def _(spark, d):
    return _flat_stars(_set_profiles(spark, d))


@query("prf3_side_by_side_sets", " UNION ALL ".join(
    f"""{_beside(c)} FROM (SELECT * FROM ({_SET_PROFILE}) WHERE DEVICE = (SELECT min(DEVICE) FROM ({_SETS}))) a,
  (SELECT * FROM ({_SET_PROFILE}) WHERE DEVICE = (SELECT max(DEVICE) FROM ({_SETS}))) b""" for c in _MEASURED),
    ("reviews", "sales", "name_mapping"))
def _(spark, d):
    profiles = cut_lineage(_set_profiles(spark, d).select("DEVICE", "STARS", *_MEASURED))
    first, last = profiles.agg(F.min("DEVICE"), F.max("DEVICE")).first()
    return _shown(pf.side_by_side(profiles, first, last))


_GROUP_CARDS = f"""SELECT n.FOCAL AS FOCAL_SERIES, n.RANK, n.Series, a.oem || ' ' || n.Series AS DISPLAY_NAME, n.SALES_UNITS_K, n.COMPETITOR_ASP,
  l.NET_SENTIMENT, a.FIRST_MONTH, a.LAST_MONTH
FROM (SELECT *, row_number() OVER (PARTITION BY FOCAL ORDER BY d, Series) AS RANK FROM (
    SELECT f.FOCAL, c.Series, CAST(sum(c.v) AS DOUBLE) / sum(c.u) AS COMPETITOR_ASP, CAST(sum(c.u) AS DOUBLE) / 1000 AS SALES_UNITS_K,
      abs(CAST(sum(c.v) AS DOUBLE) / sum(c.u) - max(f.price)) AS d
    FROM (SELECT OEMGROUP AS FOCAL, CAST(sum(Sales_Value) AS DOUBLE) / sum(Sales_Units) AS price FROM sales GROUP BY 1) f
    JOIN (SELECT DISTINCT OEMGROUP, Chassis_Segment FROM sales) s ON s.OEMGROUP = f.FOCAL
    JOIN (SELECT OEMGROUP, Series, Chassis_Segment, sum(Sales_Value) AS v, sum(Sales_Units) AS u FROM sales GROUP BY ALL) c
      ON c.Chassis_Segment = s.Chassis_Segment AND c.OEMGROUP <> f.FOCAL
    GROUP BY 1, 2)) n
JOIN (SELECT Series, min(upper(OEMGROUP)) AS oem, min(Month) AS FIRST_MONTH, max(Month) AS LAST_MONTH FROM sales GROUP BY 1) a ON a.Series = n.Series
LEFT JOIN (SELECT SalesDevice, {NS} AS NET_SENTIMENT FROM reviews JOIN name_mapping ON Product_Family = SentimentDevice GROUP BY 1) l
  ON l.SalesDevice = n.Series WHERE n.RANK <= 3"""


@query("prf2_competitors_of_name_set", f"SELECT *, {_STARS} FROM ({_GROUP_CARDS})", ("reviews", "sales", "name_mapping"))
def _(spark, d):
    """All series of one maker as one device."""
    sales = bind.sales(spark, d, "Series", "Chassis_Segment", "OEMGROUP", "Sales_Units", "Sales_Value", "Month")
    sets = sales.select(F.col("OEMGROUP").alias("DEVICE"), F.lit("sales").alias("KIND"), F.col("Series").alias("NAME")).distinct()
    return _flat_stars(pf.set_competitors(
        bind.reviews(spark, d, "Product_Family", "Sentiment_Score"), sales, sets, bind.name_mapping(spark, d)))


_DIGEST_COLUMNS = ("Product_Family", "Aspect", "Keywords", "Sentiment", "Sentiment_Score")


def _digest_sql(picked: str) -> str:
    return f"""SELECT p.PRODUCT_FAMILY, p.ASPECT, p.PLACE, p.REVIEW_COUNT, p.REVIEW_PERCENTAGE, p.ASPECT_SENTIMENT, p.NET_SENTIMENT,
  p.ASPECT_SENTIMENT - p.NET_SENTIMENT AS DIFFERENCE,
  CASE WHEN p.ASPECT_SENTIMENT > p.NET_SENTIMENT THEN 'HIGH' WHEN p.ASPECT_SENTIMENT < p.NET_SENTIMENT THEN 'LOW' ELSE ' ' END AS DIRECTION,
  k.term AS TERM, k.KEYWORD_CONTRIBUTION, k.POSITIVE_PERCENTAGE, k.NEGATIVE_PERCENTAGE, k.NEUTRAL_PERCENTAGE
FROM {picked} p JOIN keyword_stats k ON k.family = p.PRODUCT_FAMILY AND k.Aspect = p.ASPECT WHERE p.PLACE <= 4 AND k.place <= 2"""


@query("dig1_review_digest", _digest_sql("ranked_aspects"), ("ranked_aspects", "keyword_stats"))
def _(spark, d):
    return dg.review_digest(bind.reviews(spark, d, *_DIGEST_COLUMNS[:4]), nested=False)


@query("dig1_review_digest_by_count", _digest_sql("""(SELECT *, row_number() OVER (PARTITION BY PRODUCT_FAMILY ORDER BY REVIEW_COUNT DESC, ASPECT) AS PLACE
  FROM family_aspects WHERE ASPECT <> 'Generic')"""), ("family_aspects", "keyword_stats"))
def _(spark, d):
    return dg.review_digest(bind.reviews(spark, d, *_DIGEST_COLUMNS[:4]), by_count=True, nested=False)


@query("dig2_pros_cons", """SELECT * FROM (SELECT Product_Family, SIDE, Aspect, TERM, n AS REVIEW_COUNT,
  row_number() OVER (PARTITION BY Product_Family, SIDE ORDER BY n DESC, Aspect, TERM) AS PLACE
  FROM (SELECT Product_Family, CASE Sentiment WHEN 'positive' THEN 'PRO' ELSE 'CON' END AS SIDE, Aspect, Keywords AS TERM, count(*) AS n
    FROM reviews WHERE Sentiment <> 'neutral' GROUP BY ALL)) WHERE PLACE <= 3""", "reviews")
def _(spark, d):
    return dg.pros_cons(bind.reviews(spark, d, "Product_Family", "Aspect", "Keywords", "Sentiment"), k=3)


@query("dig3_verbatims", """SELECT * FROM (SELECT doc_id, Review, Product_Family, Geography, Sentiment,
  row_number() OVER (PARTITION BY Product_Family, Sentiment ORDER BY length(Review) DESC, doc_id) AS PLACE FROM text_reviews) WHERE PLACE <= 2""",
       "text_reviews")
def _(spark, d):
    return dg.verbatims(bind.text_reviews(spark, d), 2, ("Product_Family", "Sentiment"), review_id="doc_id")


@query("dig4_quantified", f"""SELECT Geography, n AS NET_SENTIMENT, REVIEW_COUNT, SORT_KEY,
  CASE WHEN n < bar THEN 'LOW' WHEN n = bar THEN ' ' ELSE 'HIGH' END AS Impact
FROM (SELECT *, (SELECT round_even({NS} * 10, 0) / 10 FROM reviews WHERE Product_Family LIKE '%BRAND#2%') AS bar FROM (
  SELECT 'TOTAL' AS Geography, round_even({NS} * 10, 0) / 10 AS n, count(*) AS REVIEW_COUNT, 0 AS SORT_KEY FROM reviews WHERE Product_Family LIKE '%BRAND#2%'
  UNION ALL SELECT Geography, round_even({NS} * 10, 0) / 10, count(*), 1 FROM reviews WHERE Product_Family LIKE '%BRAND#2%' GROUP BY 1))""", "reviews")
def _(spark, d):
    rows = bind.reviews(spark, d, "Product_Family", "Geography", "Sentiment_Score")
    return dg.quantify(rows, "Geography", [("Product_Family", "brand#2")])


@query("dig5_improvement_candidates", """SELECT * FROM (SELECT *,
  row_number() OVER (PARTITION BY Product_Family ORDER BY NEGATIVE_COUNT DESC, NET_SENTIMENT, Aspect, TERM) AS PLACE
  FROM (SELECT Product_Family, Aspect, Keywords AS TERM, count(*) FILTER (WHERE Sentiment = 'negative') AS NEGATIVE_COUNT,
    count(*) AS REVIEW_COUNT, CAST(sum(Sentiment_Score) AS DOUBLE) * 100 / count(*) AS NET_SENTIMENT
    FROM reviews GROUP BY 1, 2, 3) WHERE NEGATIVE_COUNT > 0) WHERE PLACE <= 3""", "reviews")
def _(spark, d):
    return dg.improvement_candidates(bind.reviews(spark, d, *_DIGEST_COLUMNS))
