"""Comparisons of families, with rollups, overlaps, wins and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import compare, digest
from reviewlens.plans.oracle import NS
from reviewlens.plans.registry import query
from reviewlens.sources import bindings as bind

_PAIR = ("BRAND#2 RING", "BRAND#3 BOLT")


def _rows(spark, d, dim="Aspect", *more):
    return bind.reviews(spark, d, "Product_Family", dim, "Sentiment_Score", *more)


def _level(dim: str, where: str = "true", name: str = "Product_Family") -> str:
    """Rows of a comparison: the dimension's values and the OVERALL row of each family."""
    return f"""SELECT a.f AS PRODUCT_FAMILY, a.v AS {dim.upper()}, a.ns AS NET_SENTIMENT_{dim.upper()},
  o.ns AS NET_SENTIMENT_OVERALL, a.n AS REVIEW_COUNT
FROM (SELECT {name} AS f, {dim} AS v, {NS} AS ns, count(*) AS n FROM reviews WHERE {where} GROUP BY 1, 2
      UNION ALL SELECT {name}, 'OVERALL', {NS}, count(*) FROM reviews WHERE {where} GROUP BY 1) a
JOIN (SELECT {name} AS f, {NS} AS ns FROM reviews WHERE {where} GROUP BY 1) o ON a.f = o.f"""


@query("cmp1_compare_families", _level("Aspect"), "reviews")
def _(spark, d):
    return compare.compare_families(_rows(spark, d))


@query("cmp2_with_product_rollup", f"{_level('Aspect')} UNION ALL {_level('Aspect', name='Product', where=chr(39).join(('Product = ', 'BRAND#2', '')))}", "reviews")
def _(spark, d):
    return compare.compare_families(_rows(spark, d, "Aspect", "Product"), rollup_product="BRAND#2")


@query("cmp3_with_competitors", f"{_level('Aspect', f'Product_Family IN {_PAIR}')} UNION ALL "
       f"{_level('Aspect', name='Product', where=chr(39).join(('Product = ', 'BRAND#2', '')))}", "reviews")
def _(spark, d):
    return compare.compare_families(_rows(spark, d, "Aspect", "Product"), families=_PAIR, rollup_product="BRAND#2")


@query("cmp4_by_geography", _level("Geography"), "reviews")
def _(spark, d):
    return compare.compare_families(_rows(spark, d, "Geography"), "Geography")


@query("cmp5_best_families", f"SELECT Product_Family, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews WHERE Aspect LIKE '%Promo%' GROUP BY 1", "reviews")
def _(spark, d):
    return compare.rank_families(_rows(spark, d), "promo")


@query("cmp5_worst_families", f"""SELECT Product_Family, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews
WHERE Aspect LIKE '%Promo%' GROUP BY 1 ORDER BY 2, 3 DESC, 1 LIMIT 5""", "reviews")
def _(spark, d):
    return compare.rank_families(_rows(spark, d), "promo", k=5, worst=True)


@query("cmp6_shared_topics", f"""SELECT c.* FROM ({_level('Aspect_Description')}) c JOIN (
  SELECT Aspect_Description AS v FROM reviews GROUP BY 1
  HAVING count(DISTINCT Product_Family) = (SELECT count(DISTINCT Product_Family) FROM reviews)
  UNION ALL SELECT 'OVERALL') s ON c.ASPECT_DESCRIPTION = s.v""", "reviews")
def _(spark, d):
    return compare.compare_families(_rows(spark, d, "Aspect_Description"), "Aspect_Description", overlap_only=True)


@query("cmp6_shared_geographies", f"""SELECT c.* FROM ({_level('Geography')}) c JOIN (
  SELECT Geography AS v FROM reviews GROUP BY 1
  HAVING count(DISTINCT Product_Family) = (SELECT count(DISTINCT Product_Family) FROM reviews)
  UNION ALL SELECT 'OVERALL') s ON c.GEOGRAPHY = s.v""", "reviews")
def _(spark, d):
    return compare.compare_families(_rows(spark, d, "Geography"), "Geography", overlap_only=True)


def _wins_sql(a: str, others: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{o}'" for o in others)
    return f"""SELECT *, NET_SENTIMENT - OTHERS_NET_SENTIMENT AS LEAD FROM (
  SELECT Aspect, max(CASE WHEN f = '{a}' THEN ns END) AS NET_SENTIMENT,
    avg(CASE WHEN f <> '{a}' THEN ns END) AS OTHERS_NET_SENTIMENT
  FROM (SELECT Product_Family AS f, Aspect, {NS} AS ns FROM reviews
        WHERE Product_Family IN ('{a}', {listed}) GROUP BY 1, 2) GROUP BY Aspect)
WHERE NET_SENTIMENT > OTHERS_NET_SENTIMENT"""


@query("cmp7_aspect_wins", _wins_sql(_PAIR[0], (_PAIR[1],)), "reviews")
def _(spark, d):
    return compare.aspect_wins(_rows(spark, d), _PAIR[0], [_PAIR[1]])


@query("cmp7_wins_over_mean", "SELECT Aspect, round(NET_SENTIMENT, 6) AS NET_SENTIMENT, round(OTHERS_NET_SENTIMENT, 6) AS OTHERS_NET_SENTIMENT "
       f"FROM ({_wins_sql(_PAIR[0], ('BRAND#3 BOLT', 'BRAND#4 GEAR', 'BRAND#5 ROD'))})", "reviews")
def _(spark, d):
    wins = compare.aspect_wins(_rows(spark, d), _PAIR[0], ["BRAND#3 BOLT", "BRAND#4 GEAR", "BRAND#5 ROD"])
    return wins.select("Aspect", F.round("NET_SENTIMENT", 6).alias("NET_SENTIMENT"),
                       F.round("OTHERS_NET_SENTIMENT", 6).alias("OTHERS_NET_SENTIMENT"))


_THREE = ("BRAND#2 RING", "BRAND#3 BOLT", "BRAND#4 GEAR")
_PIVOT = f"""SELECT v AS ASPECT, sum(n) AS REVIEW_COUNT_TOTAL, {', '.join(f'max(CASE WHEN f = {chr(39)}{f}{chr(39)} THEN ns END) AS "{f}"' for f in _THREE)}
FROM (SELECT Product_Family AS f, Aspect AS v, {NS} AS ns, count(*) AS n FROM reviews WHERE Product_Family IN {_THREE} GROUP BY 1, 2
      UNION ALL SELECT Product_Family, 'OVERALL', {NS}, count(*) FROM reviews WHERE Product_Family IN {_THREE} GROUP BY 1) GROUP BY v"""


@query("piv1_comparison_pivot", f"SELECT * REPLACE (CAST(REVIEW_COUNT_TOTAL AS BIGINT) AS REVIEW_COUNT_TOTAL) FROM ({_PIVOT})", "reviews")
def _(spark, d):
    table = compare.compare_families(_rows(spark, d), families=_THREE)
    return compare.comparison_pivot(table, families=_THREE, with_volume=True)


@query("piv1_first_cells", f"SELECT * EXCLUDE (REVIEW_COUNT_TOTAL) FROM ({_PIVOT})", "reviews")
def _(spark, d):
    table = compare.compare_families(_rows(spark, d), families=_THREE)
    return compare.comparison_pivot(table, families=_THREE, agg="first")


@query("piv2_split_by_entity", f"""SELECT a.ASPECT, a.NET_SENTIMENT_ASPECT AS FIRST_NET_SENTIMENT, b.NET_SENTIMENT_ASPECT AS SECOND_NET_SENTIMENT
FROM ({_level('Aspect', f"Product_Family = '{_PAIR[0]}'")}) a JOIN ({_level('Aspect', f"Product_Family = '{_PAIR[1]}'")}) b ON a.ASPECT = b.ASPECT""", "reviews")
def _(spark, d):
    first, second = compare.split_by_entity(compare.compare_families(_rows(spark, d), families=_PAIR), *_PAIR)
    return first.select("ASPECT", F.col("NET_SENTIMENT_ASPECT").alias("FIRST_NET_SENTIMENT")).join(
        second.select("ASPECT", F.col("NET_SENTIMENT_ASPECT").alias("SECOND_NET_SENTIMENT")), "ASPECT")


@query("jn1_aspect_beside_overall", "SELECT * FROM family_aspects", "family_aspects")
def _(spark, d):
    return digest.family_aspects(_rows(spark, d))
