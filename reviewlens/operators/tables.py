"""Set operations and display-ready tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from reviewlens.functions.formatting import round_numeric
from reviewlens.functions.matching import drop_total_rows


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def stack(*tables: DataFrame) -> DataFrame:
    """Concatenation that remembers the table each row came from, first table first."""
    numbered = [t.withColumn("SORT_KEY", F.lit(i)) for i, t in enumerate(tables)]
    return union_all(*numbered)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def presentation_frame(df: DataFrame) -> DataFrame:
    """Rows without totals, without REVIEW_COUNT and Impact, rounded; three columns at most.

    With more than three columns left, those holding one single value go first. Whether a column is
    constant follows from its smallest and largest value, so one small aggregate decides it.
    """
    shown = round_numeric(drop_total_rows(df).drop("REVIEW_COUNT", "Impact"))
    if len(shown.columns) <= 3:
        return shown
    ends = shown.agg(*[e for i, c in enumerate(shown.columns)
                       for e in (F.min(f"`{c}`").alias(f"low{i}"), F.max(f"`{c}`").alias(f"high{i}"))]).first()
    varied = [c for i, c in enumerate(shown.columns)
              if ends[f"low{i}"] is None or ends[f"low{i}"] != ends[f"high{i}"]]
    return shown.select(*[F.col(f"`{c}`") for c in varied[:3]])


def distribution_profile(df: DataFrame) -> DataFrame:
    """For a table of one text and one numeric column: is it a share (few categories that sum to
    about 100), and which rows are negative."""
    label = next(f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType))
    value = next(f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType))
    shape = df.agg(F.struct(F.count_distinct(label).alias("categories"), F.sum(value).alias("total"))).scalar()
    share = (shape["categories"] <= 5) & shape["total"].between(99, 101)
    return df.select(F.col(label).alias("CATEGORY"), F.col(value).alias("VALUE"),
                     F.coalesce(share, F.lit(False)).alias("IS_SHARE"),
                     F.coalesce(F.col(value) < 0, F.lit(False)).alias("IS_NEGATIVE"))
