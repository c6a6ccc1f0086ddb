"""Digests: the numeric facts behind a written summary, for all families in one job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from reviewlens.functions.formatting import impact, round_numeric
from reviewlens.functions.matching import drop_noise_aspects
from reviewlens.functions.scoring import percent
from reviewlens.functions.vocabulary import LOWER_LABELS
from reviewlens.operators.grouping import first_rows, net_of_sums, score_sums
from reviewlens.operators.keywords import term_counts, term_shares
from reviewlens.operators.measures import net_sentiment_with_total
from reviewlens.operators.ranking import aspect_ranking, top_aspects_by_count


def family_aspects(reviews: DataFrame) -> DataFrame:
    """Per family and aspect: count, share of the family's reviews, sentiment beside the overall one."""
    return _beside_family(score_sums(reviews, ["Product_Family", "Aspect"]))


def _beside_family(sums: DataFrame) -> DataFrame:
    family = Window.partitionBy("Product_Family")
    whole = F.sum("row_count").over(family)
    return sums.select(
        F.col("Product_Family").alias("PRODUCT_FAMILY"), F.col("Aspect").alias("ASPECT"),
        F.col("row_count").alias("REVIEW_COUNT"), net_of_sums().alias("ASPECT_SENTIMENT"),
        percent(F.col("row_count"), whole).alias("REVIEW_PERCENTAGE"),
        net_of_sums(F.sum("score_sum").over(family), whole).alias("NET_SENTIMENT"))


def review_digest(reviews: DataFrame, families: Sequence[str] | None = None, aspects: int = 4, terms: int = 2,
                  term_col: str = "Keywords", by_count: bool = False, nested: bool = True,
                  labels: tuple[str, str, str] = LOWER_LABELS) -> DataFrame:
    """The key aspects of each family with their leading terms.

    Aspects are picked by the aspect ranking, or by review count with ``by_count``. ``DIRECTION``
    tells whether the aspect pulls the family's sentiment up or down. ``nested`` gathers the terms
    of an aspect (at most ``terms``) into one array; otherwise there is a row per term. The reviews
    are scanned once: aspect figures are sums over the term counts.
    """
    if families is not None:
        reviews = reviews.filter(F.col("Product_Family").isin(*families))
    counts = term_counts(reviews, ["Product_Family", "Aspect", term_col], labels)
    sums = counts.groupBy("Product_Family", "Aspect").agg(
        F.sum(F.col("positive_count") - F.col("negative_count")).alias("score_sum"),
        F.sum("term_count").alias("row_count"))
    table = drop_noise_aspects(_beside_family(sums))
    key = ["PRODUCT_FAMILY"]
    picked = top_aspects_by_count(table, key, aspects) if by_count else aspect_ranking(table, key, aspects)
    difference = F.col("ASPECT_SENTIMENT") - F.col("NET_SENTIMENT")
    picked = picked.select(
        "PRODUCT_FAMILY", "ASPECT", "PLACE", "REVIEW_COUNT", "REVIEW_PERCENTAGE", "ASPECT_SENTIMENT", "NET_SENTIMENT",
        difference.alias("DIFFERENCE"),
        F.when(difference > 0, "HIGH").when(difference < 0, "LOW").otherwise(" ").alias("DIRECTION"))
    stats = term_shares(counts, ["Product_Family", "Aspect"], term_col, terms).select(
        F.col("Product_Family").alias("_family"), F.col("Aspect").alias("_aspect"), F.col(term_col).alias("TERM"),
        "KEYWORD_CONTRIBUTION", "POSITIVE_PERCENTAGE", "NEGATIVE_PERCENTAGE", "NEUTRAL_PERCENTAGE")
    joined = picked.join(stats, F.col("PRODUCT_FAMILY").eqNullSafe(F.col("_family"))
                         & F.col("ASPECT").eqNullSafe(F.col("_aspect"))).drop("_family", "_aspect")
    if not nested:
        return joined
    term = F.struct((-F.col("KEYWORD_CONTRIBUTION")).alias("order"), "TERM", "KEYWORD_CONTRIBUTION",
                    "POSITIVE_PERCENTAGE", "NEGATIVE_PERCENTAGE", "NEUTRAL_PERCENTAGE")
    return joined.groupBy(*picked.columns).agg(
        F.transform(F.sort_array(F.collect_list(term)), lambda t: t.dropFields("order")).alias("TERMS"))


def pros_cons(reviews: DataFrame, k: int = 1, term_col: str = "Keywords",
              labels: tuple[str, str, str] = LOWER_LABELS) -> DataFrame:
    """The k most frequent (aspect, term) pairs among the positive and the negative reviews of each family."""
    side = F.when(F.col("Sentiment") == labels[0], "PRO").when(F.col("Sentiment") == labels[2], "CON")
    counts = (reviews.filter(F.col("Sentiment").isin(labels[0], labels[2]))
              .groupBy("Product_Family", side.alias("SIDE"), "Aspect", F.col(term_col).alias("TERM"))
              .agg(F.count(F.lit(1)).alias("REVIEW_COUNT")))
    return first_rows(counts, ["Product_Family", "SIDE"],
                      [F.desc("REVIEW_COUNT"), F.asc("Aspect"), F.asc("TERM")], k, "PLACE")


def verbatims(reviews: DataFrame, k: int = 1, by: Sequence[str] = ("Product_Family", "Aspect", "Sentiment"),
              review_id: str | Sequence[str] = ("Review_Date", "Title")) -> DataFrame:
    """The k longest reviews of each group; among equally long ones the smallest id first, then by a hash of the text. ``review_id`` names
    the columns of the id. A review that is in several groups is judged in each; in one group it counts once.

    Only (length, id, text hash) are ranked, and at most k rows of a group and task move with them; the texts are joined to the picked
    rows by group, id and hash.
    """
    ids = [review_id] if isinstance(review_id, str) else list(review_id)
    extra = [c for c in ids if c not in by]
    keyed = reviews.withColumn("_hash", F.xxhash64("Review"))
    lengths = keyed.select(*by, *extra, "_hash", F.length("Review").alias("_length")).distinct()
    order = [F.desc("_length"), *[F.asc(c) for c in ids], F.asc("_hash")]
    picked = first_rows(lengths, list(by), order, k, "PLACE").select(
        *[F.col(c).alias(f"_{c}") for c in [*by, *extra]], F.col("_hash").alias("_picked"), "PLACE")
    same = F.col("_hash") == F.col("_picked")
    for c in [*by, *extra]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    shown = keyed.join(picked, same).drop("_picked", *[f"_{c}" for c in [*by, *extra]])
    return shown.dropDuplicates([*by, *extra, "_hash"]).drop("_hash")


def improvement_candidates(reviews: DataFrame, k: int = 3, term_col: str = "Keywords",
                           labels: tuple[str, str, str] = LOWER_LABELS) -> DataFrame:
    """Per family, the (aspect, term) pairs most frequent among negative reviews, lowest sentiment first on ties."""
    bad = F.count_if(F.col("Sentiment") == labels[2])
    counts = reviews.groupBy("Product_Family", "Aspect", F.col(term_col).alias("TERM")).agg(
        bad.alias("NEGATIVE_COUNT"), F.count(F.lit(1)).alias("REVIEW_COUNT"),
        F.sum("Sentiment_Score").alias("score_sum"))
    table = counts.withColumn("NET_SENTIMENT", net_of_sums("score_sum", "REVIEW_COUNT")).drop("score_sum")
    order = [F.desc("NEGATIVE_COUNT"), F.asc("NET_SENTIMENT"), F.asc("Aspect"), F.asc("TERM")]
    return first_rows(table.filter("NEGATIVE_COUNT > 0"), ["Product_Family"], order, k, "PLACE")


def quantify(reviews: DataFrame, by: str | Sequence[str], filters: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Net sentiment by any columns with TOTAL, rounded, each row marked above or below the total."""
    table = net_sentiment_with_total(reviews, by, filters)
    overall = table.filter("SORT_KEY = 0").agg(F.max("NET_SENTIMENT").alias("overall"))
    rounded = round_numeric(table)
    bar = round_numeric(overall).scalar()
    return rounded.withColumn("Impact", impact(F.col("NET_SENTIMENT"), bar))
