"""SQL side of the registered queries: the views as common table expressions."""

from __future__ import annotations

_STAR = """FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

_LABEL = "CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END"

VIEWS = {
    "reviews": f"""SELECT upper(p_brand) AS Product,
  upper(p_brand) || ' ' || upper(split_part(p_name, ' ', 2)) AS Product_Family,
  CASE WHEN p_type = 'STANDARD' THEN 'Generic'
       ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS Aspect,
  upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS Keywords,
  p_name AS Aspect_Description, n_name AS Geography, o_orderpriority AS Data_Source,
  CAST(l_shipdate AS DATE) AS Review_Date,
  CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS Sentiment,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS Sentiment_Score
{_STAR}""",
    "sales": f"""SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS Month, n_name AS Country,
  'OEM_' || CAST(CAST(substr(p_brand, 7) AS INT) % 5 AS VARCHAR) AS OEMGROUP,
  upper(p_brand) AS Series, p_name || ' | ' || CAST(p_size AS VARCHAR) AS Specs_Combination,
  p_type AS Chassis_Segment,
  CASE p_size % 3 WHEN 0 THEN 'Windows OS' WHEN 1 THEN 'Apple OS' ELSE 'Google OS' END AS Operating_System_Summary,
  CAST(l_quantity AS BIGINT) AS Sales_Units, CAST(l_extendedprice AS DECIMAL(18,2)) AS Sales_Value,
  l_extendedprice / l_quantity AS ASP
{_STAR}""",
    "name_mapping": """SELECT DISTINCT Product AS SalesDevice, Product_Family AS SentimentDevice FROM reviews""",
    "text_reviews": f"""SELECT d.doc_id, d.text AS Review, d.source AS Product_Family, d.lang AS Geography,
  {_LABEL} AS Sentiment
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "family_aspects": """SELECT Product_Family AS PRODUCT_FAMILY, Aspect AS ASPECT, count(*) AS REVIEW_COUNT,
  CAST(sum(Sentiment_Score) AS DOUBLE) * 100 / count(*) AS ASPECT_SENTIMENT,
  CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (PARTITION BY Product_Family) AS REVIEW_PERCENTAGE,
  CAST(sum(sum(Sentiment_Score)) OVER (PARTITION BY Product_Family) AS DOUBLE) * 100
    / sum(count(*)) OVER (PARTITION BY Product_Family) AS NET_SENTIMENT
FROM reviews GROUP BY Product_Family, Aspect""",
    "ranked_aspects": """SELECT *, row_number() OVER (PARTITION BY PRODUCT_FAMILY ORDER BY ASPECT_RANKING, ASPECT) AS PLACE
FROM (SELECT *, count(*) OVER (PARTITION BY PRODUCT_FAMILY ORDER BY points DESC NULLS LAST
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ASPECT_RANKING
  FROM (SELECT *,
      (1 - (ASPECT_SENTIMENT - min(ASPECT_SENTIMENT) OVER f)
         / nullif(max(ASPECT_SENTIMENT) OVER f - min(ASPECT_SENTIMENT) OVER f, 0))
      + 3 * (CAST(REVIEW_COUNT - min(REVIEW_COUNT) OVER f AS DOUBLE)
         / nullif(max(REVIEW_COUNT) OVER f - min(REVIEW_COUNT) OVER f, 0)) AS points
    FROM family_aspects WHERE ASPECT_SENTIMENT <> 0 AND ASPECT <> 'Generic'
    WINDOW f AS (PARTITION BY PRODUCT_FAMILY)))""",
    "nearest": """SELECT *, row_number() OVER (PARTITION BY FOCAL_SERIES ORDER BY PRICE_DIFFERENCE, Series) AS RANK
FROM (SELECT f.Series AS FOCAL_SERIES, c.Series,
    CAST(sum(c.v) AS DOUBLE) / sum(c.u) AS COMPETITOR_ASP, CAST(sum(c.u) AS DOUBLE) / 1000 AS SALES_UNITS_K,
    abs(CAST(sum(c.v) AS DOUBLE) / sum(c.u) - max(f.price)) AS PRICE_DIFFERENCE
  FROM (SELECT Series, CAST(sum(Sales_Value) AS DOUBLE) / sum(Sales_Units) AS price FROM sales GROUP BY Series) f
  JOIN (SELECT DISTINCT Series, Chassis_Segment FROM sales) s ON s.Series = f.Series
  JOIN (SELECT Series, Chassis_Segment, sum(Sales_Value) AS v, sum(Sales_Units) AS u
        FROM sales GROUP BY Series, Chassis_Segment) c
    ON c.Chassis_Segment = s.Chassis_Segment AND c.Series <> f.Series
  GROUP BY f.Series, c.Series)""",
    "keyword_stats": """SELECT *, CAST(term_count AS DOUBLE) * 100 / aspect_count AS KEYWORD_CONTRIBUTION,
  CAST(pos AS DOUBLE) * 100 / aspect_count AS POSITIVE_PERCENTAGE,
  CAST(neg AS DOUBLE) * 100 / aspect_count AS NEGATIVE_PERCENTAGE,
  CAST(neu AS DOUBLE) * 100 / aspect_count AS NEUTRAL_PERCENTAGE,
  row_number() OVER (PARTITION BY family, Aspect ORDER BY term_count DESC, term) AS place
FROM (SELECT Product_Family AS family, Aspect, Keywords AS term, count(*) AS term_count,
    count(*) FILTER (WHERE Sentiment = 'positive') AS pos, count(*) FILTER (WHERE Sentiment = 'negative') AS neg,
    count(*) FILTER (WHERE Sentiment = 'neutral') AS neu,
    sum(count(*)) OVER (PARTITION BY Product_Family, Aspect) AS aspect_count
  FROM reviews GROUP BY Product_Family, Aspect, Keywords)""",
}

_NEEDS = {
    "name_mapping": ("reviews",),
    "family_aspects": ("reviews",),
    "ranked_aspects": ("reviews", "family_aspects"),
    "nearest": ("sales",),
    "keyword_stats": ("reviews",),
}

# Net sentiment over the rows of a group.
NS = "CAST(sum(Sentiment_Score) AS DOUBLE) * 100 / count(*)"


def with_views(select: str, views: str | tuple[str, ...]) -> str:
    """A SELECT with the views it reads in front of it."""
    asked = (views,) if isinstance(views, str) else views
    names: list[str] = []
    for v in asked:
        for n in (*_NEEDS.get(v, ()), v):
            if n not in names:
                names.append(n)
    if not names:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + select
