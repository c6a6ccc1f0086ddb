"""Derived and display columns. Rounding lives here and only here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from reviewlens.functions.scoring import as_column
from reviewlens.functions.vocabulary import (
    HEAT_HIGH, HEAT_LOW, HEAT_MIDDLE, UNKNOWN,
)


def half_up(col: str | Column, digits: int = 1) -> Column:
    """Round half away from zero, the rounding of SQL results."""
    scale = 10 ** digits
    return F.round(as_column(col) * scale) / scale


def half_even(col: str | Column, digits: int = 1) -> Column:
    """Round half to even, the rounding of data-frame displays."""
    scale = 10 ** digits
    return F.rint(as_column(col) * scale) / scale


def title_case(col: str | Column) -> Column:
    """Capitalise every letter run: ``e-mail 3d`` becomes ``E-Mail 3D``."""
    runs = F.split(F.lower(as_column(col)), r"(?<![\p{Lu}\p{Ll}\p{Lt}])(?=[\p{Lu}\p{Ll}\p{Lt}])")
    return F.array_join(F.transform(runs, F.initcap), "")


def normalize_keys(df: DataFrame, upper: tuple[str, ...] = ("Product", "Product_Family"),
                   title: tuple[str, ...] = ("Keywords",)) -> DataFrame:
    """Fold the key columns once, so that later filters and joins compare them directly."""
    folded = {c: F.upper(c) for c in upper if c in df.columns}
    folded |= {c: title_case(c) for c in title if c in df.columns}
    return df.withColumns(folded) if folded else df


def fill_unknown(df: DataFrame, text: str = UNKNOWN) -> DataFrame:
    return df.na.fill(text)


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def round_numeric(df: DataFrame, digits: int = 1) -> DataFrame:
    """Half-even rounding of every fractional column; whole-number columns stay as they are."""
    fractional = (T.DoubleType, T.FloatType)
    rounded = {f.name: half_even(f"`{f.name}`", digits) for f in df.schema.fields
               if isinstance(f.dataType, fractional)}
    rounded |= {f.name: F.bround(f"`{f.name}`", digits) for f in df.schema.fields
                if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(rounded) if rounded else df


def impact(value: Column, overall: Column) -> Column:
    """``LOW`` below the overall figure, blank when equal, otherwise ``HIGH``."""
    return F.when(value < overall, "LOW").when(value == overall, " ").otherwise("HIGH")


def with_impact(df: DataFrame, overall: float | Column, value: str = "NET_SENTIMENT", digits: int = 1) -> DataFrame:
    bar = overall if isinstance(overall, Column) else F.lit(float(overall))
    return df.withColumn("Impact", impact(half_even(value, digits), half_even(bar, digits)))


def star_rating(col: str | Column) -> Column:
    """Net sentiment in -100..100 as full, half and empty stars out of five."""
    stars = (as_column(col) + 100) / 40
    full = F.floor(stars).cast("int")
    half = (stars - full >= 0.5).cast("int")
    return F.when(stars.isNotNull(), F.struct(
        full.alias("full"), half.alias("half"), (5 - full - half).alias("empty")))


def heat_color(col: str | Column, vmin: float = -100, vmax: float = 100, truncate: bool = False) -> Column:
    """Colour on the diverging scale; ``truncate`` drops the fraction of the value first."""
    value = as_column(col).cast("double")
    if truncate:
        value = value.cast("long").cast("double")
    width = float(vmax) - float(vmin)
    place = (value - float(vmin)) / width * 2 - 1 if width else F.when(value.isNotNull(), F.lit(0.0))
    place = F.when(place < -1, -1.0).when(place > 1, 1.0).otherwise(place)

    def channel(low: int, middle: int, high: int) -> Column:
        below = (place + 1) * float(middle - low) + float(low)
        above = place * float(high - middle) + float(middle)
        return F.when(place <= 0, below).otherwise(above).cast("int")

    channels = [channel(*c) for c in zip(HEAT_LOW, HEAT_MIDDLE, HEAT_HIGH)]
    return F.when(value.isNotNull(), F.format_string("#%02x%02x%02x", *channels))


def fmt_thousands(col: str | Column) -> Column:
    return F.concat(F.rint(as_column(col)).cast("long").cast("string"), F.lit("K"))


def fmt_usd(col: str | Column) -> Column:
    return F.concat(F.lit("$"), F.rint(as_column(col)).cast("long").cast("string"))


def parse_count(col: str | Column) -> Column:
    """``'1,234.0'`` becomes 1234; text that is no number becomes null."""
    return F.regexp_replace(as_column(col).cast("string"), ",", "").try_cast("double").cast("long")


def display_name(oem: str | Column, series: str | Column) -> Column:
    return F.concat_ws(" ", F.upper(as_column(oem)), as_column(series))


def parse_month(col: str | Column) -> Column:
    return F.to_date(as_column(col), "M/d/yyyy")


def format_day(col: str | Column) -> Column:
    return F.date_format(as_column(col), "yyyy-MM-dd")


def year_of(col: str | Column) -> Column:
    """Year of a ``MM/dd/yyyy`` text by position, without parsing it."""
    return F.substring(as_column(col), 7, 4)


def month_of(col: str | Column) -> Column:
    return F.substring(as_column(col), 1, 2)


def to_int(df: DataFrame) -> DataFrame:
    """Truncate every fractional column towards zero; nulls stay null."""
    whole = {f.name: F.col(f"`{f.name}`").cast("long") for f in df.schema.fields
             if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))}
    return df.withColumns(whole) if whole else df


def tag(df: DataFrame, **labels: str) -> DataFrame:
    """Add constant label columns."""
    return df.withColumns({name: F.lit(text) for name, text in labels.items()})
