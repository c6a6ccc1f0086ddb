"""Sales measures and the two definitions of a competitor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.functions.matching import ci_match, is_folded, valid_sales
from reviewlens.functions.vocabulary import COMPETITOR_SYSTEMS
from reviewlens.operators.grouping import first_rows, numbered
from reviewlens.sources.storage import cut_lineage


def _names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _of_series(sales: DataFrame, series: str | None, match: str) -> DataFrame:
    return sales if series is None else sales.filter(ci_match("Series", series, match, is_folded(sales, "Series")))


def thousands(units: str | Column) -> Column:
    units = F.col(units) if isinstance(units, str) else units
    return units.cast("double") / 1000


def price_of(value: str = "Sales_Value", units: str = "Sales_Units") -> Column:
    """Average selling price from summed value and units; null without units."""
    return F.try_divide(F.sum(value).cast("double"), F.sum(units))


def units_k(sales: DataFrame, series: str | None = None, by: str | Sequence[str] = (),
            match: str = "contains") -> DataFrame:
    """Units sold in thousands, always fractional."""
    keys = _names(by)
    out = _of_series(sales, series, match).groupBy(*keys).agg(thousands(F.sum("Sales_Units")).alias("SALES_UNITS_K"))
    return out.orderBy(F.desc("SALES_UNITS_K"), *keys) if keys else out


def asp(sales: DataFrame, series: str | None = None, by: str | Sequence[str] = (),
        match: str = "contains") -> DataFrame:
    keys = _names(by)
    out = _of_series(sales, series, match).groupBy(*keys).agg(price_of().alias("ASP"))
    return out.orderBy(F.desc("ASP"), *keys) if keys else out


def price_range(sales: DataFrame, series: str | None = None, by: str | Sequence[str] = (),
                match: str = "contains") -> DataFrame:
    """Lowest and highest row price among rows with units and a price that is not negative."""
    rows = _of_series(sales, series, match).filter(valid_sales())
    return rows.groupBy(*_names(by)).agg(F.min("ASP").alias("LOWEST_VALUE"), F.max("ASP").alias("HIGHEST_VALUE"))


def top_specs(sales: DataFrame, series: str | None = None, k: int = 1, by: str | Sequence[str] = (),
              match: str = "contains") -> DataFrame:
    """Best-selling configurations, overall or per key."""
    keys = _names(by)
    rows = _of_series(sales, series, match).filter(F.col("Sales_Units") != 0)
    totals = rows.groupBy(*keys, "Specs_Combination").agg(thousands(F.sum("Sales_Units")).alias("SALES_UNITS_K"))
    order = [F.desc("SALES_UNITS_K"), F.asc("Specs_Combination")]
    if not keys:
        return totals.orderBy(*order).limit(k)
    return first_rows(totals, keys, order, k).drop("_rank")


def monthly_asp(sales: DataFrame, series: str | None = None, match: str = "contains") -> DataFrame:
    """Mean of the row prices per month, in month order."""
    return (_of_series(sales, series, match).groupBy("Month")
            .agg(F.avg("ASP").alias("AVERAGE_ASP")).orderBy("Month"))


def sales_by(sales: DataFrame, dims: str | Sequence[str], series: str | None = None,
             match: str = "contains") -> DataFrame:
    """Units, value and price by any columns."""
    keys = _names(dims)
    return (_of_series(sales, series, match).groupBy(*keys)
            .agg(F.sum("Sales_Units").alias("SALES_UNITS"),
                 F.sum("Sales_Value").cast("double").alias("SALES_VALUE"), price_of().alias("ASP"))
            .orderBy(F.desc("SALES_UNITS"), *keys))


def date_range(sales: DataFrame, by: str | Sequence[str] = "Series") -> DataFrame:
    keys = _names(by)
    return sales.groupBy(*keys).agg(F.min("Month").alias("FIRST_MONTH"), F.max("Month").alias("LAST_MONTH"))


def without_series(sales: DataFrame, series: str, match: str = "contains") -> DataFrame:
    """Sales of every other series."""
    return sales.filter(~ci_match("Series", series, match, is_folded(sales, "Series")))


def price_band_join(focal: DataFrame, others: DataFrame, band: float) -> DataFrame:
    """Pairs in the same chassis segment whose prices differ by at most ``band``.

    Takes per-series aggregates. The segment is the join key and the band a condition on it, so
    Spark plans a hash or sort-merge join and not a nested loop.
    """
    f = focal.select(F.col("Chassis_Segment").alias("_segment"), F.col("ASP").alias("FOCAL_ASP"))
    near = (F.col("Chassis_Segment") == F.col("_segment")) & (F.abs(F.col("ASP") - F.col("FOCAL_ASP")) <= band)
    return others.join(f, near).drop("_segment")


def competitors_band(sales: DataFrame, series: str, band: float = 400, k: int = 3, match: str = "contains",
                     systems: Sequence[str] = COMPETITOR_SYSTEMS) -> DataFrame:
    """The k best-selling other series per chassis segment within a price band of the focal series."""
    focal = (sales.filter(ci_match("Series", series, match, is_folded(sales, "Series")))
             .groupBy("Chassis_Segment").agg(price_of().alias("ASP")))
    others = (without_series(sales, series, match).filter(F.col("Operating_System_Summary").isin(*systems))
              .groupBy("Series", "Chassis_Segment")
              .agg(price_of().alias("ASP"), F.sum("Sales_Units").alias("Sales_Units")))
    near = price_band_join(focal, others, band)
    top = first_rows(near, ["Chassis_Segment"], [F.desc("Sales_Units"), F.asc("Series")], k, "RANK")
    return top.select("Series", F.col("ASP").alias("COMPETITOR_ASP"), "Chassis_Segment", "Sales_Units", "RANK")


def _priced(base: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups of series with the segments that they are sold in, their number of series, and the price over all of these."""
    return (base.join(groups, "Series").groupBy("FOCAL").agg(
        F.collect_set("Chassis_Segment").alias("segments"), F.count_distinct("Series").alias("members"),
        F.try_divide(F.sum("value").cast("double"), F.sum("units")).alias("price")).filter("price IS NOT NULL"))


def _near_pairs(base: DataFrame, focal: DataFrame, k: int, rows: int) -> DataFrame:
    """Pairs (FOCAL, Series) that share a segment, the k nearest in price of each focal certainly among them.

    Over any segments, a series has a price between the lowest and the highest of its prices by segment. So series and focals are
    sorted by price within each segment and cut into ranges of ``rows``, and a range is known by the lowest and the highest price in
    it and its number of series. The own range and those beside it, as many as hold k others, settle how far the k-th nearest can
    be; then ranges, and last series, whose prices reach that near, are looked into, and no others.
    """
    hull = Window.partitionBy("Series")  # the segments of one series
    price = F.try_divide(F.col("value").cast("double"), F.col("units"))
    sound = F.min(F.col("units") > 0).over(hull)  # without units in a segment its price tells nothing
    infinite = F.lit(float("inf"))
    sold = base.select(
        F.col("Chassis_Segment").alias("segment"), "Series", F.lit(None).cast("string").alias("FOCAL"),
        F.when(sound, F.min(price).over(hull)).otherwise(-infinite).alias("low"), F.when(sound, F.max(price).over(hull)).otherwise(infinite).alias("high"),
        F.coalesce(F.try_divide(F.sum(F.col("value").cast("double")).over(hull), F.sum("units").over(hull)), infinite).alias("at"), F.lit(None).cast("long").alias("members"))
    asking = focal.select(F.explode("segments").alias("segment"), F.lit(None).cast("string").alias("Series"), "FOCAL",
                          F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.col("price").alias("at"), "members")
    # Series with one and the same price in all segments tie for everyone, by name; only the first can ever be shown.
    shown = focal.agg(F.max("members") + k)
    flat = first_rows(sold.filter("low = high"), ["segment", "at"], [F.asc("Series")], 2**31 - 1, "tie").filter(F.col("tie") <= shown.scalar()).drop("tie")
    sold = flat.union(sold.filter("NOT low = high"))
    order = [F.col("segment"), F.col("at"), F.col("Series"), F.col("FOCAL")]
    laid = cut_lineage(numbered(sold.union(asking), order).withColumn("range", F.floor(F.col("_place") / rows)).drop("_place"))
    members, asked = laid.filter("Series IS NOT NULL"), laid.filter("FOCAL IS NOT NULL")
    ranges = members.groupBy("segment", "range").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n"))

    # How far the k-th nearest can be: whole ranges around the focal, nearest first, until they hold k series besides its own.
    beside = asked.select("segment", "FOCAL", "at", "members", F.explode(F.sequence(F.col("range") - 2, F.col("range") + 2)).alias("range"))
    reach = F.greatest(F.abs(F.col("low") - F.col("at")), F.abs(F.col("high") - F.col("at")))
    nearest = Window.partitionBy("segment", "FOCAL").orderBy("reach").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # five rows
    certain = (beside.join(ranges, ["segment", "range"]).withColumn("reach", reach)
               .withColumn("held", F.sum("n").over(nearest)).filter(F.col("held") >= F.col("members") + k)
               .groupBy("FOCAL").agg(F.min("reach").alias("radius")))
    # A price over segments may lie outside of those by segment by the rounding of a division.
    wide = asked.join(certain, "FOCAL", "left").withColumn("radius", F.coalesce(F.col("radius") * (1 + 1e-9) + 1e-9, infinite))
    wide = wide.select("FOCAL", "segment", "range", (F.col("at") - F.col("radius")).alias("from"), (F.col("at") + F.col("radius")).alias("to"))
    wide = cut_lineage(wide)

    spans = wide.groupBy("segment", "range").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    met = spans.join(ranges.withColumnRenamed("range", "other"), "segment").filter("low <= to AND high >= from").select("segment", "range", "other")
    return (wide.join(met, ["segment", "range"]).join(members.select("segment", F.col("range").alias("other"), "Series", "low", "high"), ["segment", "other"])
            .filter("low <= to AND high >= from").select("FOCAL", "Series").distinct())


def competitors_nearest(sales: DataFrame, series: str | None = None, k: int = 3, groups: DataFrame | None = None,
                        range_rows: int = 128) -> DataFrame:
    """The k other series nearest in price among those sharing a chassis segment.

    A competitor's price and units count only the segments it shares with the focal series. With ``groups`` (FOCAL, Series) each
    FOCAL stands for all of its series: its segments and its price are those of all, and none of them competes with it.
    Series are not paired with each other: see ``_near_pairs``.
    """
    # One aggregate serves every step below: all of them read both sums of named series and segments.
    base = cut_lineage(sales.filter("Series IS NOT NULL AND Chassis_Segment IS NOT NULL").groupBy("Series", "Chassis_Segment").agg(
        F.sum("Sales_Value").alias("value"), F.sum("Sales_Units").alias("units")))
    if groups is None:
        names = base.select("Series").distinct().withColumn("FOCAL", F.col("Series"))
        groups = names if series is None else names.filter(F.col("Series") == series)
    groups = groups.select(F.col("FOCAL").cast("string").alias("FOCAL"), "Series").distinct()
    focal = cut_lineage(_priced(base, groups))
    pairs = _near_pairs(base, focal, k, range_rows).join(groups, ["FOCAL", "Series"], "left_anti")
    found = (pairs.join(focal.drop("members"), "FOCAL").join(base, "Series").filter(F.array_contains("segments", F.col("Chassis_Segment")))
             .groupBy("FOCAL", "Series").agg(
                 F.try_divide(F.sum("value").cast("double"), F.sum("units")).alias("COMPETITOR_ASP"), F.sum("units").alias("units"), F.max("price").alias("price"))
             .filter("COMPETITOR_ASP IS NOT NULL")
             .select(F.col("FOCAL").alias("FOCAL_SERIES"), "Series", "COMPETITOR_ASP", thousands("units").alias("SALES_UNITS_K"),
                     F.abs(F.col("COMPETITOR_ASP") - F.col("price")).alias("PRICE_DIFFERENCE")))
    return first_rows(found, ["FOCAL_SERIES"], [F.asc("PRICE_DIFFERENCE"), F.asc("Series")], k, "RANK")
