"""Scoring of sentiment labels and the two ratios everything else is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.functions.vocabulary import LOWER_LABELS


def as_column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sentiment_score(col: str | Column, positive: str = "positive", negative: str = "negative") -> Column:
    """+1 / -1 for the two labels; anything else, null included, scores 0."""
    label = as_column(col)
    return F.when(label == positive, 1).when(label == negative, -1).otherwise(0)


def with_score(df: DataFrame, labels: tuple[str, str, str] = LOWER_LABELS, col: str = "Sentiment") -> DataFrame:
    return df.withColumn("Sentiment_Score", sentiment_score(col, labels[0], labels[2]))


def with_review_count(df: DataFrame) -> DataFrame:
    """The constant count of one per row. The operators use ``count`` and do not need it."""
    return df.withColumn("Review_Count", F.lit(1.0))


def percent(part: Column, whole: Column) -> Column:
    """part as a percentage of whole, null when whole is zero (ANSI division would raise)."""
    return F.try_divide(part.cast("double") * 100, whole)


def net_sentiment_of(score: str = "Sentiment_Score") -> Column:
    return percent(F.sum(score), F.count(F.lit(1)))
