"""Small building blocks shared by the aggregate operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.functions.scoring import percent
from reviewlens.sources.storage import cut_lineage


def score_sums(df: DataFrame, keys: Sequence[str | Column], score: str = "Sentiment_Score") -> DataFrame:
    """Score sum and row count per key. Everything coarser is computed from these few rows, so
    the reviews are scanned and shuffled once, after partial aggregation."""
    return df.groupBy(*keys).agg(F.sum(score).alias("score_sum"), F.count(F.lit(1)).alias("row_count"))


def net_of_sums(score: str | Column = "score_sum", rows: str | Column = "row_count") -> Column:
    score = F.col(score) if isinstance(score, str) else score
    rows = F.col(rows) if isinstance(rows, str) else rows
    return percent(score, rows)


def add_group_totals(grouped: DataFrame, keys: Sequence[str], **measures: str) -> DataFrame:
    """Add the sum of a measure over each key group: ``total_name="measure"``.

    A join on the re-aggregated rows rather than a window: a group with very many rows is summed
    by partial aggregates and never has to sit in one task.
    """
    totals = grouped.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        *[F.sum(m).alias(name) for name, m in measures.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return grouped.join(totals, condition).drop(*[f"_{k}" for k in keys])


def grand_total(grouped: DataFrame, measure: str) -> Column:
    """The sum of a measure over the whole table as a scalar subquery, computed once."""
    return grouped.agg(F.sum(measure)).scalar()


def first_rows(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int,
               rank: str = "_rank") -> DataFrame:
    """The k first rows per key. Spark cuts each task's rows to k per key before the shuffle, so a
    hot key sends at most k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores before costly per-row work. Adaptive execution merges partitions by their
    size in bytes, which would leave a few megabytes of names or blocks to a single core."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "_place") -> DataFrame:
    """The rows with their place in this order, from 0, as a new column.

    A distributed prefix sum: ranges of rows are sorted and counted on their own, and each is moved up by what the ranges before
    it hold, so that nothing but a count per range meets in one task. Rows that are equal in ``order`` fall into one range; give a
    full order where many may be. The rows are written once, so places stay the same if a task is run again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return places(cut_lineage(laid.withColumn(name, F.monotonically_increasing_id())), name)


def places(laid: DataFrame, name: str) -> DataFrame:
    """Written rows whose column ``name`` is their ``monotonically_increasing_id``, which is replaced by their place."""
    part = F.shiftright(name, 33)
    counts = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("_part", (F.coalesce(before, F.lit(0)) - F.shiftleft("_part", 33)).alias("_shift"))
    return (laid.join(F.broadcast(shifts), part == F.col("_part"))  # a row per partition
            .withColumn(name, F.col(name) + F.col("_shift")).drop("_part", "_shift"))
