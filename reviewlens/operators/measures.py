"""Review measures: net sentiment, counts, distributions, aspect tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.functions.formatting import half_up
from reviewlens.functions.matching import any_contains, apply_filters, ci_contains, ci_match, is_folded
from reviewlens.functions.scoring import net_sentiment_of, percent
from reviewlens.functions.vocabulary import RATED_ASPECTS, TOTAL
from reviewlens.operators.grouping import grand_total, net_of_sums, score_sums


def _names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def net_sentiment(df: DataFrame, by: str | Sequence[str] = (), filters: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Net sentiment and review count, overall or per key, most reviewed first."""
    keys = _names(by)
    out = apply_filters(df, filters).groupBy(*keys).agg(
        net_sentiment_of().alias("NET_SENTIMENT"), F.count(F.lit(1)).alias("REVIEW_COUNT"))
    return out.orderBy(F.desc("REVIEW_COUNT"), *keys) if keys else out


def net_sentiment_by_two(df: DataFrame, x: str, y: str) -> DataFrame:
    """Net sentiment by two columns, the one with fewer values first."""
    pairs = df.select(x, y).distinct()
    values = pairs.agg(F.count_distinct(x).alias("x"), F.count_distinct(y).alias("y")).first()
    return net_sentiment(df, [x, y] if values["x"] <= values["y"] else [y, x])


def sentiment_mark(df: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    keys = _names(by)
    out = df.groupBy(*keys).agg(F.sum("Sentiment_Score").alias("SENTIMENT_MARK"))
    return out.orderBy(F.desc("SENTIMENT_MARK"), *keys) if keys else out


def top_by_mark(df: DataFrame, by: str = "Geography", k: int = 1) -> DataFrame:
    return sentiment_mark(df, by).limit(k)


def review_count(df: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    keys = _names(by)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("REVIEW_COUNT"))
    return out.orderBy(F.desc("REVIEW_COUNT"), *keys) if keys else out


def top_by_count(df: DataFrame, by: str, k: int = 1) -> DataFrame:
    return review_count(df, by).limit(k)


def count_of(df: DataFrame, x: str, by: str | Sequence[str] = ()) -> DataFrame:
    """Non-null values of a column, overall or per key."""
    return df.groupBy(*_names(by)).agg(F.count(x).alias("VALUE_COUNT"))


def count_distinct_of(df: DataFrame, x: str, by: str | Sequence[str] = (), approximate: bool = False) -> DataFrame:
    measure = F.approx_count_distinct(x) if approximate else F.count_distinct(x)
    return df.groupBy(*_names(by)).agg(measure.alias("DISTINCT_COUNT"))


def distinct_sketches(df: DataFrame, x: str, keys: Sequence[str], precision: int = 12) -> DataFrame:
    """A sketch of the distinct values of a column for each of the finest keys: keys and ``SKETCH``. Sketches can be kept and
    merged, so that any coarser count follows from them without the rows. The relative standard error is 1.04 / 2^(precision / 2),
    1.6 % at 12; small counts are exact."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(x, precision).alias("SKETCH"))


def distinct_of_sketches(sketches: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """The estimated number of distinct values, overall or per key, from kept sketches."""
    return sketches.groupBy(*_names(by)).agg(F.hll_sketch_estimate(F.hll_union_agg("SKETCH")).alias("DISTINCT_ESTIMATE"))


def aspect_summary(df: DataFrame, family: str | None = None, filters: Iterable[tuple[str, str]] = (),
                   aspect: str | None = None, total_match: str = "contains", match: str = "contains",
                   aspect_col: str = "Aspect", family_col: str = "Product_Family", digits: int | None = 1) -> DataFrame:
    """TOTAL row plus one row per aspect: ASPECT, ASPECT_SENTIMENT, REVIEW_COUNT.

    ``aspect`` keeps a single aspect while TOTAL stays the overall figure. ``total_match='equals'``
    takes TOTAL from the exact family name and the aspects from every name that contains it.
    Both levels come from one scan: grouping sets over the per-aspect sums.
    """
    rows = apply_filters(df, filters)
    in_total = F.lit(True)
    if family is not None:
        rows = rows.filter(ci_match(family_col, family, match, is_folded(df, family_col)))
        if total_match != match:
            in_total = ci_match(family_col, family, total_match, is_folded(df, family_col))
    sums = (rows.withColumn("in_total", in_total)
            .groupBy(F.col(aspect_col).alias("aspect_key"), "in_total")
            .agg(F.sum("Sentiment_Score").alias("score_sum"), F.count(F.lit(1)).alias("row_count")))
    is_total = F.grouping("aspect_key") == 1

    def level_sum(measure: str) -> Column:
        return F.when(is_total, F.sum(F.when(F.col("in_total"), F.col(measure)))).otherwise(F.sum(measure))

    both = sums.groupingSets([["aspect_key"], []], "aspect_key").agg(
        is_total.alias("is_total"), level_sum("score_sum").alias("score_sum"),
        level_sum("row_count").alias("row_count"))
    if aspect is not None:
        both = both.filter(F.col("is_total") | ci_contains("aspect_key", aspect))
    sentiment = net_of_sums()
    return (both.select(
        F.when(F.col("is_total"), TOTAL).otherwise(F.col("aspect_key")).alias("ASPECT"),
        (sentiment if digits is None else half_up(sentiment, digits)).alias("ASPECT_SENTIMENT"),
        F.col("row_count").alias("REVIEW_COUNT"))
        .orderBy(F.desc("REVIEW_COUNT"), "ASPECT"))


def aspect_ratings(df: DataFrame, family: str | None = None, aspects: Sequence[str] = RATED_ASPECTS,
                   by: Sequence[str] = ()) -> DataFrame:
    """Net sentiment of a fixed list of aspects, one column each, 0 for an aspect without reviews."""
    rows = df if family is None else df.filter(ci_contains("Product_Family", family))
    sums = score_sums(rows, [*by, "Aspect"])

    def rating(aspect: str) -> Column:
        hit = F.col("Aspect") == aspect
        value = percent(F.sum(F.when(hit, F.col("score_sum"))), F.sum(F.when(hit, F.col("row_count"))))
        return F.coalesce(value, F.lit(0.0)).alias(aspect)

    return sums.groupBy(*by).agg(*[rating(a) for a in aspects])


def _share_of_all(grouped: DataFrame, measure: str, keys: Sequence[str], alias: str) -> DataFrame:
    shared = grouped.select(*keys, percent(F.col(measure), grand_total(grouped, measure)).alias(alias))
    return shared.orderBy(F.desc(alias), *keys)


def review_distribution(df: DataFrame, x: str) -> DataFrame:
    """Reviews per value as a percentage of all reviews."""
    grouped = df.groupBy(x).agg(F.count(F.lit(1)).alias("part"))
    return _share_of_all(grouped, "part", [x], "REVIEW_DISTRIBUTION")


def measure_distribution(df: DataFrame, measure: str, by: str) -> DataFrame:
    """The sum of a measure per value as a percentage of its overall sum."""
    grouped = df.groupBy(by).agg(F.sum(measure).alias("part"))
    return _share_of_all(grouped, "part", [by], "DISTRIBUTION_PCT")


def sentiment_distribution(df: DataFrame) -> DataFrame:
    grouped = df.groupBy("Sentiment").agg(F.count(F.lit(1)).alias("part"))
    return _share_of_all(grouped, "part", ["Sentiment"], "TOTAL_REVIEWS")


def review_mix(df: DataFrame, family: str, x: str = "Aspect") -> DataFrame:
    """Review share by aspect inside one family; the denominator is that family too."""
    grouped = df.filter(ci_contains("Product_Family", family)).groupBy(x).agg(F.count(F.lit(1)).alias("part"))
    return _share_of_all(grouped, "part", [x], "REVIEW_COUNT_PERCENTAGE")


def net_sentiment_with_total(df: DataFrame, by: str | Sequence[str],
                             filters: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Net sentiment per key with a TOTAL row over the same filters; ``SORT_KEY`` 0 marks it."""
    keys = _names(by)
    sums = score_sums(apply_filters(df, filters), keys)
    is_total = F.grouping_id() > 0
    both = sums.groupingSets([keys, []], *keys).agg(
        is_total.alias("is_total"), F.sum("score_sum").alias("score_sum"), F.sum("row_count").alias("row_count"))
    labels = [F.when(F.col("is_total"), TOTAL).otherwise(F.col(k).cast("string")).alias(k) for k in keys]
    return (both.select(*labels, net_of_sums().alias("NET_SENTIMENT"), F.col("row_count").alias("REVIEW_COUNT"),
                        F.when(F.col("is_total"), 0).otherwise(1).alias("SORT_KEY"))
            .orderBy("SORT_KEY", F.desc("REVIEW_COUNT"), *keys))


def with_total_row(df: DataFrame, detail: DataFrame, filters: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Prepend a TOTAL row, taken over the filtered reviews, to any table with NET_SENTIMENT."""
    total = net_sentiment(apply_filters(df, filters))
    labels = [F.lit(TOTAL).alias(c) for c in detail.columns if c not in ("NET_SENTIMENT", "REVIEW_COUNT")]
    head = total.select(*labels, "NET_SENTIMENT", "REVIEW_COUNT", F.lit(0).alias("SORT_KEY"))
    return head.unionByName(detail.withColumn("SORT_KEY", F.lit(1))).orderBy("SORT_KEY", F.desc("REVIEW_COUNT"))


def with_review_percentage(summary: DataFrame, label: str = "ASPECT") -> DataFrame:
    """Add each row's share of the TOTAL row's review count."""
    whole = summary.filter(F.col(label) == TOTAL).agg(F.max("REVIEW_COUNT")).scalar()
    return summary.withColumn("REVIEW_PERCENTAGE", percent(F.col("REVIEW_COUNT"), whole))


def aspect_ns_wide(df: DataFrame, families: Sequence[str], aspects: Sequence[str]) -> DataFrame:
    """Net sentiment of named aspects per family, one column per aspect."""
    sums = score_sums(df.filter(any_contains("Product_Family", families)), ["Product_Family", "Aspect"])

    def cell(aspect: str) -> Column:
        hit = F.upper("Aspect") == aspect.upper()
        return percent(F.sum(F.when(hit, F.col("score_sum")).otherwise(0)),
                       F.sum(F.when(hit, F.col("row_count")).otherwise(0))).alias(aspect)

    return sums.groupBy("Product_Family").agg(*[cell(a) for a in aspects])


def aspect_ns_long(df: DataFrame, families: Sequence[str], aspects: Sequence[str]) -> DataFrame:
    """The same as rows ``(Product_Family, ASPECT, NET_SENTIMENT)``; null where there are no reviews."""
    wide = aspect_ns_wide(df, families, aspects)
    return (wide.unpivot("Product_Family", list(aspects), "ASPECT", "NET_SENTIMENT")
            .orderBy("Product_Family", "ASPECT"))


def compare_one_aspect(df: DataFrame, families: Sequence[str], aspect: str) -> DataFrame:
    hit = any_contains("Product_Family", families) & (F.upper("Aspect") == aspect.upper())
    out = df.filter(hit).groupBy("Product_Family").agg(net_sentiment_of().alias("NET_SENTIMENT"))
    return out.withColumn("ASPECT", F.lit(aspect)).orderBy(F.desc("NET_SENTIMENT"), "Product_Family")


def set_net_sentiment(df: DataFrame, families: Sequence[str], by: str | Sequence[str] = "Aspect") -> DataFrame:
    """Net sentiment, in percent, over a set of exact family names."""
    return net_sentiment(df.filter(F.col("Product_Family").isin(*families)), by)


def trend(df: DataFrame, period: str = "month", by: str | Sequence[str] = ()) -> DataFrame:
    """Net sentiment and count per review period, in time order."""
    keys = _names(by)
    start = F.date_trunc(period, F.col("Review_Date").cast("timestamp")).cast("date").alias("PERIOD")
    out = df.groupBy(start, *keys).agg(
        net_sentiment_of().alias("NET_SENTIMENT"), F.count(F.lit(1)).alias("REVIEW_COUNT"))
    return out.orderBy("PERIOD", *keys)
