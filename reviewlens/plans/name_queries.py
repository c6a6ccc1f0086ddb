"""Name mapping, aliases, mentions and fuzzy matching over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import measures as ms, names as nm
from reviewlens.plans.oracle import NS
from reviewlens.plans.registry import query
from reviewlens.sources import bindings as bind


@query("jn2_case_insensitive_join", f"""SELECT b.p_brand AS BRAND, r.Product, r.NET_SENTIMENT, r.REVIEW_COUNT
FROM (SELECT DISTINCT p_brand FROM part) b
JOIN (SELECT Product, {NS} AS NET_SENTIMENT, count(*) AS REVIEW_COUNT FROM reviews GROUP BY 1) r ON upper(b.p_brand) = upper(r.Product)""", "reviews")
def _(spark, d):
    brands = bind.table(spark, d, "part").select(F.col("p_brand").alias("BRAND")).distinct()
    return nm.ci_join(brands, ms.net_sentiment(bind.reviews(spark, d, "Product", "Sentiment_Score"), "Product"), "BRAND", "Product")


_PART_MAPPING = "(SELECT * FROM name_mapping WHERE SalesDevice LIKE '%BRAND#2%')"


def _partial_mapping(spark, d):
    return bind.name_mapping(spark, d).filter(F.col("SalesDevice").contains("BRAND#2"))


@query("jn4_mapped_only", f"""SELECT Product_Family, count(*) AS REVIEW_COUNT FROM reviews
WHERE Product_Family IN (SELECT SentimentDevice FROM {_PART_MAPPING}) GROUP BY 1""", "name_mapping")
def _(spark, d):
    kept = nm.restrict_to_mapped(bind.reviews(spark, d, "Product_Family"), _partial_mapping(spark, d), "Product_Family", "SentimentDevice")
    return ms.review_count(kept, "Product_Family")


@query("jn5_unmapped_only", f"""SELECT Product_Family, count(*) AS REVIEW_COUNT FROM reviews
WHERE Product_Family NOT IN (SELECT SentimentDevice FROM {_PART_MAPPING}) GROUP BY 1""", "name_mapping")
def _(spark, d):
    kept = nm.exclude_names(bind.reviews(spark, d, "Product_Family"), _partial_mapping(spark, d), "Product_Family", "SentimentDevice")
    return ms.review_count(kept, "Product_Family")


_ASKED = "(SELECT SalesDevice AS n FROM name_mapping UNION SELECT SentimentDevice FROM name_mapping UNION SELECT n_name FROM nation)"


def _asked(spark, d):
    mapping = bind.name_mapping(spark, d)
    nations = bind.table(spark, d, "nation").select(F.col("n_name").alias("NAME"))
    return (mapping.select(F.col("SalesDevice").alias("NAME"))
            .union(mapping.select("SentimentDevice")).union(nations).distinct())


@query("jn6_sales_name", f"""SELECT n AS NAME, coalesce((SELECT min(SalesDevice) FROM name_mapping WHERE SentimentDevice = n),
  (SELECT min(SalesDevice) FROM name_mapping WHERE SalesDevice = n)) AS SALES_NAME FROM {_ASKED}""", "name_mapping")
def _(spark, d):
    return nm.to_sales_name(_asked(spark, d), bind.name_mapping(spark, d), "NAME")


@query("jn7_review_name", f"""SELECT n AS NAME, coalesce((SELECT min(SentimentDevice) FROM name_mapping WHERE SentimentDevice = n),
  (SELECT min(SentimentDevice) FROM name_mapping WHERE SalesDevice = n)) AS SENTIMENT_NAME FROM {_ASKED}""", "name_mapping")
def _(spark, d):
    return nm.to_sentiment_name(_asked(spark, d), bind.name_mapping(spark, d), "NAME")


@query("jn8_all_review_names", f"""SELECT n AS NAME, coalesce(a.SentimentDevice, b.SentimentDevice) AS SENTIMENT_NAME FROM {_ASKED}
LEFT JOIN (SELECT DISTINCT SentimentDevice FROM name_mapping) a ON a.SentimentDevice = n
LEFT JOIN name_mapping b ON a.SentimentDevice IS NULL AND b.SalesDevice = n""", "name_mapping")
def _(spark, d):
    return nm.to_sentiment_names(_asked(spark, d), bind.name_mapping(spark, d), "NAME")


@query("jn8_name_groups", """SELECT c.g AS DEVICE, k.KIND, k.NAME
FROM (SELECT OEMGROUP, min(Series) AS g FROM sales GROUP BY 1) c
JOIN (SELECT DISTINCT OEMGROUP, 'sales' AS KIND, Series AS NAME FROM sales UNION SELECT DISTINCT OEMGROUP, 'review', OEMGROUP FROM sales) k USING (OEMGROUP)""",
       "sales")
def _(spark, d):
    """Series that are linked by their maker, whose name stands for the review name here."""
    pairs = bind.sales(spark, d, "Series", "OEMGROUP").select(F.col("Series").alias("SalesDevice"), F.col("OEMGROUP").alias("SentimentDevice"))
    return nm.name_groups(pairs)


def _catalog(spark, d):
    """Every word of the part names."""
    parts = bind.table(spark, d, "part")
    return parts.select(F.explode(F.split("p_name", " ")).alias("name")).distinct()


@query("jn11_detected_mentions", """SELECT doc_id, NAME, CAST(r AS INT) AS MENTION_RANK FROM (
  SELECT doc_id, NAME, row_number() OVER (PARTITION BY doc_id ORDER BY length(NAME) DESC, NAME) AS r
  FROM documents JOIN (SELECT DISTINCT upper(unnest(string_split(p_name, ' '))) AS NAME FROM part)
    ON contains(upper(text), NAME)) WHERE r <= 2""")
def _(spark, d):
    return nm.detect_mentions(bind.table(spark, d, "documents"), _catalog(spark, d), 2, "doc_id")


def _spoken(spark, d):
    """A loose wording of each part: brand, kind and noun, as someone might ask for it."""
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    return bind.table(spark, d, "part").select(F.concat_ws(" ", noun, "p_type", "p_brand").alias("mention"))


def _families(spark, d):
    return bind.name_mapping(spark, d).select(F.col("SentimentDevice").alias("name"))


_WORDED = """(SELECT DISTINCT upper(split_part(p_name, ' ', 2) || ' ' || p_type || ' ' || p_brand) AS mention,
  upper(p_brand || ' ' || split_part(p_name, ' ', 2)) AS family FROM part)"""


@query("jn12_fuzzy_best", f"""SELECT mention, family AS NAME, CAST(100 AS DOUBLE) AS SCORE
FROM {_WORDED} WHERE family IN (SELECT SentimentDevice FROM name_mapping)""", "name_mapping")
def _(spark, d):
    return nm.fuzzy_match(_spoken(spark, d), _families(spark, d), 95)


# The token-set ratio of two names: common words, what is left of either, and the longest common subsequence of that, a machine word
# of letters at a time.
_RATIO = f"""WITH pairs AS (SELECT DISTINCT mention, SentimentDevice AS NAME,
    list_sort(list_distinct(string_split(mention, ' '))) AS a, list_sort(list_distinct(string_split(SentimentDevice, ' '))) AS b
  FROM {_WORDED}, (SELECT DISTINCT SentimentDevice FROM name_mapping)),
split AS (SELECT mention, NAME, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ' ') AS head,
    array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' ') AS ta, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ' ') AS tb FROM pairs),
sized AS (SELECT *, CAST(head <> '' AS INT) AS gap, length(head) + CAST(head <> '' AS INT) + length(ta) AS la, length(head) + CAST(head <> '' AS INT) + length(tb) AS lb FROM split),
near AS (SELECT *, CASE WHEN abs(length(ta) - length(tb)) < 0.2 * (la + lb) THEN list_reduce(
    list_prepend((CAST(1 AS HUGEINT) << length(ta)) - 1, list_transform(string_split(tb, ''), lambda c: CAST(list_sum(list_transform(range(0, length(ta)),
      lambda i: CASE WHEN substr(ta, CAST(i AS INT) + 1, 1) = c THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE 0 END)) AS HUGEINT))),
    lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((CAST(1 AS HUGEINT) << length(ta)) - 1)) END AS state FROM sized),
scored AS (SELECT mention, NAME, CASE WHEN gap = 1 AND (ta = '' OR tb = '') THEN 100.0 ELSE greatest(
    coalesce(100 - 100 * CAST(length(ta) + length(tb) - 2 * (length(ta) - bit_count(state)) AS DOUBLE) / (la + lb), 0),
    gap * (100 - 100 * CAST(1 + length(ta) AS DOUBLE) / (length(head) + la)), gap * (100 - 100 * CAST(1 + length(tb) AS DOUBLE) / (length(head) + lb))) END AS SCORE FROM near)"""


@query("jn12_fuzzy_all", f"SELECT mention, NAME, round(CAST(SCORE AS DOUBLE), 6) AS SCORE FROM ({_RATIO} SELECT * FROM scored) WHERE SCORE > 80", "name_mapping")
def _(spark, d):
    return nm.fuzzy_match(_spoken(spark, d), _families(spark, d), 80, "all").withColumn("SCORE", F.round("SCORE", 6))


@query("jn13_resolved_devices")
def _(spark, d):
    turns = bind.table(spark, d, "conversations").select(F.col("text").alias("mention"))
    asked = _spoken(spark, d).unionByName(turns)
    sold = bind.name_mapping(spark, d).select(F.col("SalesDevice").alias("name"))
    return nm.resolve_device(asked, _families(spark, d), sold)


@query("jn14_canonical_names", """SELECT n_name AS GEOGRAPHY, count(*) AS CUSTOMERS
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(spark, d):
    nations = bind.table(spark, d, "nation")
    aliases = nations.select(F.lit("geography").alias("domain"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("alias"),
                             F.col("n_name").alias("canonical"))
    coded = bind.table(spark, d, "customer").select(F.concat(F.lit(" n"), F.col("c_nationkey").cast("string")).alias("GEOGRAPHY"))
    return nm.canonicalize(coded, "GEOGRAPHY", aliases, "geography").groupBy("GEOGRAPHY").agg(
        F.count(F.lit(1)).alias("CUSTOMERS"))
