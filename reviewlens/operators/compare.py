"""Comparison of families over a dimension, with rollups and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.functions.matching import ci_contains, ci_equals
from reviewlens.functions.vocabulary import OVERALL
from reviewlens.operators.grouping import net_of_sums, score_sums
from reviewlens.operators.measures import net_sentiment


def compare_families(df: DataFrame, dim: str = "Aspect", families: Sequence[str] | None = None,
                     rollup_product: str | None = None, overlap_only: bool = False) -> DataFrame:
    """Net sentiment per family and dimension value beside the family's overall figure.

    One row per pair plus an OVERALL row per family. ``rollup_product`` adds the parent product as
    one more family, with its own values and OVERALL row; a ``families`` list limits the families
    but not the rollup. ``overlap_only`` keeps the values that all shown families share. One scan:
    the sums per product, family and value feed every level.
    """
    if families is not None:
        wanted = F.col("Product_Family").isin(*families)
        if rollup_product is not None:
            wanted = wanted | ci_equals("Product", rollup_product)
        df = df.filter(wanted)
    keys = ["Product_Family", dim] + (["Product"] if rollup_product is not None else [])
    sums = score_sums(df, keys)

    own = F.struct(F.lit(0).alias("level"), F.col("Product_Family").alias("name"))
    if families is not None:
        own = F.when(F.col("Product_Family").isin(*families), own)
    names = [own]
    if rollup_product is not None:
        parent = F.struct(F.lit(1).alias("level"), F.lit(rollup_product).alias("name"))
        names.append(F.when(ci_equals("Product", rollup_product), parent))
    rows = (sums.withColumn("entity", F.explode(F.array(*names))).filter("entity IS NOT NULL")
            .select("entity.level", "entity.name", F.col(dim).alias("value"), "score_sum", "row_count"))

    both = rows.groupingSets([["level", "name", "value"], ["level", "name"]], "level", "name", "value").agg(
        (F.grouping("value") == 1).alias("is_overall"),
        F.sum("score_sum").alias("score_sum"), F.sum("row_count").alias("row_count"))
    net = net_of_sums()
    overall = F.max(F.when(F.col("is_overall"), net)).over(Window.partitionBy("level", "name"))
    name, figure = dim.upper(), f"NET_SENTIMENT_{dim.upper()}"
    out = both.select(
        F.col("name").alias("PRODUCT_FAMILY"),
        F.when(F.col("is_overall"), OVERALL).otherwise(F.col("value")).alias(name),
        net.alias(figure), overall.alias("NET_SENTIMENT_OVERALL"), F.col("row_count").alias("REVIEW_COUNT"))
    if overlap_only:
        out = shared_values(out, name)
    return out.orderBy(F.desc("REVIEW_COUNT"), "PRODUCT_FAMILY", name)


def shared_values(comparison: DataFrame, dim: str = "ASPECT", entity: str = "PRODUCT_FAMILY") -> DataFrame:
    """Only the dimension values that every entity of the comparison has."""
    everyone = comparison.agg(F.count_distinct(entity)).scalar()
    common = (comparison.groupBy(dim).agg(F.count_distinct(entity).alias("present"))
              .filter(F.col("present") == everyone).select(dim))
    return comparison.join(common, dim, "left_semi")


def rank_families(df: DataFrame, aspect: str, k: int | None = None, worst: bool = False) -> DataFrame:
    """Families by net sentiment on one aspect, best (or worst) first."""
    table = net_sentiment(df.filter(ci_contains("Aspect", aspect)), "Product_Family")
    order = F.asc_nulls_last("NET_SENTIMENT") if worst else F.desc_nulls_last("NET_SENTIMENT")
    table = table.orderBy(order, F.desc("REVIEW_COUNT"), "Product_Family")
    return table if k is None else table.limit(k)


def aspect_wins(df: DataFrame, a: str, others: Sequence[str], dim: str = "Aspect") -> DataFrame:
    """Values of the dimension where family ``a`` beats the mean of the other families."""
    sums = score_sums(df.filter(F.col("Product_Family").isin(a, *others)), ["Product_Family", dim])
    own = F.col("Product_Family") == a
    figures = sums.groupBy(dim).agg(
        F.max(F.when(own, net_of_sums())).alias("NET_SENTIMENT"),
        F.avg(F.when(~own, net_of_sums())).alias("OTHERS_NET_SENTIMENT"))
    lead = F.col("NET_SENTIMENT") - F.col("OTHERS_NET_SENTIMENT")
    return figures.withColumn("LEAD", lead).filter("LEAD > 0").orderBy(F.desc("LEAD"), dim)


def _column_values(df: DataFrame, col: str) -> list[str]:
    """The distinct values that become columns; more than Spark's own pivot limit is an error."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{col} has more than {limit} values, too many for columns; pass the ones to show")
    return sorted(found)


def comparison_pivot(comparison: DataFrame, dim: str = "ASPECT", families: Sequence[str] | None = None,
                     agg: str = "mean", with_volume: bool = False) -> DataFrame:
    """One row per dimension value, largest total volume first; one column per family.

    Cells are the mean net sentiment, or with ``agg='first'`` that of the most reviewed row. A
    comparison without PRODUCT_FAMILY is spread over PRODUCT instead. Cells and volume come from
    one grouped pass.
    """
    entity = "PRODUCT_FAMILY" if "PRODUCT_FAMILY" in comparison.columns else "PRODUCT"
    figure = F.col(f"NET_SENTIMENT_{dim}")
    columns = list(families) if families is not None else _column_values(comparison, entity)

    def cell(name: str) -> Column:
        hit = F.col(entity) == name
        if agg == "first":
            best = F.struct(F.col("REVIEW_COUNT"), figure)
            return F.max(F.when(hit, best))[f"NET_SENTIMENT_{dim}"].alias(name)
        return F.avg(F.when(hit, figure)).alias(name)

    wide = comparison.groupBy(dim).agg(F.sum("REVIEW_COUNT").alias("REVIEW_COUNT_TOTAL"), *[cell(c) for c in columns])
    ordered = wide.orderBy(F.desc("REVIEW_COUNT_TOTAL"), dim)
    return ordered if with_volume else ordered.drop("REVIEW_COUNT_TOTAL")


def split_by_entity(table: DataFrame, a: str, b: str, entity: str = "PRODUCT_FAMILY") -> tuple[DataFrame, DataFrame]:
    """A stacked two-entity table as two tables."""
    return table.filter(F.col(entity) == a), table.filter(F.col(entity) == b)
