"""Keyword and topic statistics. ``term_col`` picks keywords or topic descriptions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from reviewlens.functions.matching import apply_filters, ci_contains, is_folded
from reviewlens.functions.scoring import net_sentiment_of, percent
from reviewlens.functions.vocabulary import LOWER_LABELS
from reviewlens.operators.grouping import add_group_totals, first_rows


def term_counts(df: DataFrame, keys: Sequence[str], labels: tuple[str, str, str] = LOWER_LABELS) -> DataFrame:
    """Reviews per key by sentiment, and their sum ``term_count``.

    The four counts are disjoint and every use takes the sum of all of them, so the branches of a
    plan that start from this table have the same aggregate and share one scan and one shuffle.
    """
    positive, neutral, negative = labels
    label = F.col("Sentiment")
    parts = ["positive_count", "negative_count", "neutral_count", "other_count"]
    return df.groupBy(*keys).agg(
        F.count_if(label == positive).alias(parts[0]),
        F.count_if(label == negative).alias(parts[1]),
        F.count_if(label == neutral).alias(parts[2]),
        F.count_if(F.coalesce(~label.isin(positive, negative, neutral), F.lit(True))).alias(parts[3]),
    ).withColumn("term_count", F.col(parts[0]) + F.col(parts[1]) + F.col(parts[2]) + F.col(parts[3]))


def term_shares(counts: DataFrame, group: Sequence[str], term: str, k: int | None = 2, base: str = "aspect") -> DataFrame:
    """Contribution and sentiment shares of the k leading terms per group, from term counts."""
    table = add_group_totals(counts, group, aspect_count="term_count")
    if k is not None:
        table = first_rows(table, group, [F.desc("term_count"), F.asc(term)], k)
    whole = F.col("aspect_count" if base == "aspect" else "term_count")
    return table.select(
        *group, term,
        percent(F.col("positive_count"), whole).alias("POSITIVE_PERCENTAGE"),
        percent(F.col("negative_count"), whole).alias("NEGATIVE_PERCENTAGE"),
        percent(F.col("neutral_count"), whole).alias("NEUTRAL_PERCENTAGE"),
        percent(F.col("term_count"), F.col("aspect_count")).alias("KEYWORD_CONTRIBUTION"))


def keyword_stats(df: DataFrame, family: str | None = None, aspects: Sequence[str] | None = None,
                  term_col: str = "Keywords", k: int | None = 2, by: Sequence[str] = (),
                  base: str = "aspect", labels: tuple[str, str, str] = LOWER_LABELS) -> DataFrame:
    """Contribution and sentiment shares of the leading terms of each aspect.

    All percentages are over the aspect's reviews (``base='aspect'``); ``base='term'`` puts the
    sentiment shares over the term's own reviews. ``by`` adds outer keys such as the family, so
    that every family is served by one job. ``k=None`` keeps all terms.
    """
    rows = df
    if family is not None:
        rows = rows.filter(ci_contains("Product_Family", family, is_folded(df, "Product_Family")))
    if aspects is not None:
        rows = rows.filter(F.col("Aspect").isin(*aspects))
    group = [*by, "Aspect"]
    return term_shares(term_counts(rows, [*group, term_col], labels), group, term_col, k, base)


def top_keywords(df: DataFrame, filters: Iterable[tuple[str, str]] = (), k: int = 10, term_col: str = "Keywords",
                 labels: tuple[str, str, str] = LOWER_LABELS) -> DataFrame:
    """The most frequent terms with the share of each sentiment in the term's own reviews."""
    counts = term_counts(apply_filters(df, filters), [term_col], labels)
    whole = F.col("term_count")
    return (counts.select(
        term_col, whole.alias("REVIEW_COUNT"),
        percent(F.col("positive_count"), whole).alias("POSITIVE_PERCENTAGE"),
        percent(F.col("negative_count"), whole).alias("NEGATIVE_PERCENTAGE"),
        percent(F.col("neutral_count"), whole).alias("NEUTRAL_PERCENTAGE"))
        .orderBy(F.desc("REVIEW_COUNT"), term_col).limit(k))


def keyword_net_sentiment(df: DataFrame, aspect: str = "End User Usecase") -> DataFrame:
    """Net sentiment per family and keyword inside one aspect."""
    rows = df.filter(F.upper("Aspect") == aspect.upper())
    return (rows.groupBy("Product_Family", "Keywords")
            .agg(net_sentiment_of().alias("NET_SENTIMENT_KEYWORDS"), F.count(F.lit(1)).alias("REVIEW_COUNT"))
            .orderBy(F.desc("REVIEW_COUNT"), "Product_Family", "Keywords"))


def aspect_topics(df: DataFrame) -> DataFrame:
    return df.select("Aspect", "Aspect_Description").distinct().orderBy("Aspect", "Aspect_Description")


def topic_counts(df: DataFrame, family: str | None = None) -> DataFrame:
    rows = df if family is None else df.filter(ci_contains("Product_Family", family, is_folded(df, "Product_Family")))
    return (rows.groupBy("Aspect", "Aspect_Description").agg(F.count(F.lit(1)).alias("REVIEW_COUNT"))
            .orderBy(F.desc("REVIEW_COUNT"), "Aspect", "Aspect_Description"))


def best_worst_topics(df: DataFrame, family: str | None = None,
                      labels: tuple[str, str, str] = LOWER_LABELS) -> DataFrame:
    """The most praised and the most criticised topic of each aspect; ties are all kept."""
    rows = df if family is None else df.filter(ci_contains("Product_Family", family, is_folded(df, "Product_Family")))
    feature = (F.when(F.col("Sentiment") == labels[0], "Most Preferred")
               .when(F.col("Sentiment") == labels[2], "Most Concerning"))
    counts = (rows.filter(F.col("Sentiment").isin(labels[0], labels[2]))
              .groupBy(feature.alias("FEATURE"), "Aspect", "Aspect_Description")
              .agg(F.count(F.lit(1)).alias("REVIEW_COUNT")))
    place = F.rank().over(Window.partitionBy("FEATURE", "Aspect").orderBy(F.desc("REVIEW_COUNT")))
    return (counts.withColumn("_rank", place).filter("_rank = 1").drop("_rank")
            .orderBy(F.desc("FEATURE"), F.desc("REVIEW_COUNT"), "Aspect", "Aspect_Description"))
