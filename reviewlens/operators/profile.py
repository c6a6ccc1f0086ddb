"""Device profiles and competitor cards, for all devices in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.functions.formatting import display_name, star_rating
from reviewlens.functions.scoring import percent
from reviewlens.functions.vocabulary import RATED_ASPECTS
from reviewlens.operators.grouping import net_of_sums, score_sums
from reviewlens.operators.names import to_sentiment_names
from reviewlens.operators.sales import competitors_nearest, thousands


def _device_sums(reviews: DataFrame, mapping: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Score sums per sales device. A device that is a review name itself has its own reviews, any other those of its mapped names.
    Reviews are summed per family before they meet the mapping."""
    sums = score_sums(reviews, ["Product_Family", *keys])
    devices = mapping.select(F.col("SalesDevice").alias("DEVICE")).distinct()
    pairs = to_sentiment_names(devices, mapping, "DEVICE", "SentimentDevice")
    joined = sums.join(pairs, F.col("Product_Family") == F.col("SentimentDevice"))
    return joined.groupBy("DEVICE", *keys).agg(
        F.sum("score_sum").alias("score_sum"), F.sum("row_count").alias("row_count"))


def _rated(by_aspect: DataFrame, aspects: Sequence[str]) -> DataFrame:
    """Net sentiment, reviews and aspect ratings of each DEVICE, from sums by aspect."""
    def rating(aspect: str) -> Column:
        hit = F.col("Aspect") == aspect
        value = percent(F.sum(F.when(hit, F.col("score_sum"))), F.sum(F.when(hit, F.col("row_count"))))
        return F.coalesce(value, F.lit(0.0)).alias(f"RATING_{aspect.upper()}")

    net = net_of_sums(F.sum("score_sum"), F.sum("row_count"))
    return by_aspect.groupBy("DEVICE").agg(
        net.alias("NET_SENTIMENT"), F.sum("row_count").alias("REVIEW_COUNT"), *[rating(a) for a in aspects])


def _sums_by_specs(sales: DataFrame, key: str) -> DataFrame:
    return sales.groupBy(key, "Specs_Combination").agg(
        F.sum("Sales_Units").alias("units"), F.sum("Sales_Value").alias("value"),
        F.min("Month").alias("first"), F.max("Month").alias("last"))


def _sold(by_specs: DataFrame, key: str) -> DataFrame:
    """Units, price, best configuration and dates of each key."""
    best = F.struct(-F.col("units"), F.col("Specs_Combination"))
    return by_specs.groupBy(F.col(key).alias("_series")).agg(
        thousands(F.sum("units")).alias("SALES_UNITS_K"),
        F.try_divide(F.sum("value").cast("double"), F.sum("units")).alias("ASP"),
        F.min_by("Specs_Combination", best).alias("TOP_SPECS"),
        thousands(F.min_by("units", best)).alias("TOP_SPECS_UNITS_K"),
        F.min("first").alias("FIRST_MONTH"), F.max("last").alias("LAST_MONTH"))


def _joined(devices: DataFrame, liked: DataFrame, sold: DataFrame) -> DataFrame:
    joined = (devices.join(liked, "DEVICE", "left")
              .join(sold, F.col("DEVICE") == F.col("_series"), "left").drop("_series"))
    return joined.withColumn("STARS", star_rating("NET_SENTIMENT"))


def device_profile(reviews: DataFrame, sales: DataFrame, mapping: DataFrame,
                   aspects: Sequence[str] = RATED_ASPECTS) -> DataFrame:
    """One row per mapped device: sentiment, stars, aspect ratings, units, price, best configuration, dates."""
    devices = mapping.select(F.col("SalesDevice").alias("DEVICE")).distinct()
    return _joined(devices, _rated(_device_sums(reviews, mapping, ["Aspect"]), aspects), _sold(_sums_by_specs(sales, "Series"), "Series"))


def _of_sets(sums: DataFrame, sets: DataFrame, kind: str, name: str, keys: Sequence[str], **pooled: Column) -> DataFrame:
    """Sums of the names of each set, added up by DEVICE and keys. Sums are made per name before they meet the sets, so a row of
    facts is counted once for a set however many ways lead to it, and in every set that has its name."""
    names = sets.filter(F.col("KIND") == kind).select("DEVICE", F.col("NAME").alias("_name")).distinct()
    return sums.join(names, F.col(name) == F.col("_name")).groupBy("DEVICE", *keys).agg(*[c.alias(n) for n, c in pooled.items()])


def set_profile(reviews: DataFrame, sales: DataFrame, sets: DataFrame, aspects: Sequence[str] = RATED_ASPECTS) -> DataFrame:
    """One row per set of names: as :func:`device_profile`, pooled over all names of the set.

    ``sets`` has ``DEVICE, KIND, NAME``, as :func:`~reviewlens.operators.names.name_groups` and ``sets_of_names`` give it. The best
    configuration is the one that sold most over all series of the set.
    """
    sums = score_sums(reviews, ["Product_Family", "Aspect"])
    by_aspect = _of_sets(sums, sets, "review", "Product_Family", ["Aspect"], score_sum=F.sum("score_sum"), row_count=F.sum("row_count"))
    by_specs = _of_sets(_sums_by_specs(sales, "Series"), sets, "sales", "Series", ["Specs_Combination"],
                        units=F.sum("units"), value=F.sum("value"), first=F.min("first"), last=F.max("last"))
    return _joined(sets.select("DEVICE").distinct(), _rated(by_aspect, aspects), _sold(by_specs, "DEVICE"))


def set_competitors(reviews: DataFrame, sales: DataFrame, sets: DataFrame, mapping: DataFrame, k: int = 3) -> DataFrame:
    """Up to k nearest-price competitors of every set of names, none of which is in the set, as cards."""
    groups = sets.filter("KIND = 'sales'").select(F.col("DEVICE").alias("FOCAL"), F.col("NAME").alias("Series"))
    return _cards(competitors_nearest(sales, k=k, groups=groups), reviews, sales, mapping)


def competitor_cards(reviews: DataFrame, sales: DataFrame, mapping: DataFrame, k: int = 3) -> DataFrame:
    """Up to k nearest-price competitors of every device, with their own sales and sentiment."""
    return _cards(competitors_nearest(sales, k=k), reviews, sales, mapping)


def _cards(rivals: DataFrame, reviews: DataFrame, sales: DataFrame, mapping: DataFrame) -> DataFrame:
    about = sales.groupBy(F.col("Series").alias("_series")).agg(
        F.min(F.upper("OEMGROUP")).alias("oem"),
        F.min("Month").alias("FIRST_MONTH"), F.max("Month").alias("LAST_MONTH"))
    liked = _device_sums(reviews, mapping).select(F.col("DEVICE").alias("_device"), net_of_sums().alias("NET_SENTIMENT"))
    return (rivals.join(about, F.col("Series") == F.col("_series"), "left")
            .join(liked, F.col("Series") == F.col("_device"), "left")
            .select("FOCAL_SERIES", "RANK", "Series", display_name("oem", "Series").alias("DISPLAY_NAME"),
                    "SALES_UNITS_K", "COMPETITOR_ASP", "NET_SENTIMENT",
                    star_rating("NET_SENTIMENT").alias("STARS"), "FIRST_MONTH", "LAST_MONTH"))


def side_by_side(profiles: DataFrame, a: str, b: str) -> DataFrame:
    """Two profiles as rows ``(MEASURE, FIRST, SECOND)``, every value as text."""
    measures = [c for c in profiles.columns if c not in ("DEVICE", "STARS")]
    rows = profiles.filter(F.col("DEVICE").isin(a, b)).select(
        "DEVICE", *[F.col(c).cast("string").alias(c) for c in measures])
    return rows.unpivot("DEVICE", measures, "MEASURE", "VALUE").groupBy("MEASURE").agg(
        F.max(F.when(F.col("DEVICE") == a, F.col("VALUE"))).alias("FIRST"),
        F.max(F.when(F.col("DEVICE") == b, F.col("VALUE"))).alias("SECOND"))
