"""Ranks, normalisation, ordering and limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from reviewlens.functions.vocabulary import SENTIMENT_WEIGHT, TOTAL, VOLUME_WEIGHT
from reviewlens.operators.grouping import first_rows
from reviewlens.sources.storage import cut_lineage


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    rank: str = "RANK") -> DataFrame:
    """Exactly k rows per group; give a full order so that ties are settled."""
    return first_rows(df, keys, order, k, rank)


def rank_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
             rank: str = "RANK") -> DataFrame:
    """Rows of rank at most k per group, ties kept."""
    place = F.rank().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def _running(keys: int):
    """Running counts per key over rows sorted by key, with what each stretch of a key holds in all on its last row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [["nan" if v != v else v for v in batch.column(i).to_pylist()] for i in range(keys)]
            rows = batch.column("_rows").to_numpy()
            sums, own = np.zeros(len(rows), np.int64), list(zip(*names)) if keys else [()] * len(rows)
            for i, (name, n) in enumerate(zip(own, rows.tolist())):
                total = n if name != held else total + n
                held, sums[i] = name, total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], [*batch.schema.names, "_inside"])
    return run


def rank_max(df: DataFrame, col: str, partition: Sequence[str] = (), rank: str = "RANK") -> DataFrame:
    """Descending rank in which tied rows all take the largest rank of their tie; nulls come last.

    The rank of a value is the number of rows with that value or a larger one. Rows are counted per distinct value, and a
    distributed prefix sum goes over the counts: they are shuffled once, into ranges of (partition, value) of as many values each,
    summed up inside a range, and moved up by what the ranges before hold of the same partition. So neither a hot partition nor a
    frequent value is sorted by one task. Then rows look up their value. Values with more rows than a fair share of a task, of which
    there are fewer than tasks, are sent to all of them, and their rows are spread.
    """
    spark, keys = df.sparkSession, list(partition)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col(col).desc_nulls_last()]
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_rows"))
    laid = counts.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*laid.schema.fields, T.StructField("_inside", T.LongType())])
    summed = cut_lineage(laid.mapInArrow(_running(len(keys)), schema))

    def of(frame: DataFrame, prefix: str) -> Column:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(frame[f"{prefix}{k}"])
        return same

    # A range boundary cuts one partition at most, so fewer rows than ranges have anything to move up by.
    held = summed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_at")).agg(F.max("_inside").alias("_held"))
    before = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    shifts = F.broadcast(held.withColumn("_shift", F.sum("_held").over(before)).filter("_shift > 0").drop("_held"))
    ranked = (summed.join(shifts, of(shifts, "_") & (F.col("_part") == F.col("_at")), "left")
              .select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(col).alias("_value"), "_rows",
                      (F.col("_inside") + F.coalesce("_shift", F.lit(0))).alias(rank)))

    fair = summed.agg(F.sum("_rows") / parts)
    frequent = F.broadcast(ranked.filter(F.col("_rows") > fair.scalar())  # fewer than ``parts`` values
                           .select(*[F.col(f"_{k}").alias(f"_f_{k}") for k in keys], F.col("_value").alias("_f_value"), F.col(rank).alias("_f_rank")))
    marked = df.join(frequent, of(frequent, "_f_") & F.col(col).eqNullSafe(F.col("_f_value")), "left").drop("_f_value", *[f"_f_{k}" for k in keys])
    # Rows that have their rank go anywhere; the others to their value.
    salted = marked.withColumn("_salt", F.when(F.col("_f_rank").isNotNull(), F.monotonically_increasing_id() + 1).otherwise(0))
    rest = ranked.withColumn("_to", F.when(F.col("_rows") <= fair.scalar(), 0).cast("long")).drop("_rows")
    found = of(rest, "_") & F.col(col).eqNullSafe(F.col("_value")) & (F.col("_salt") == F.col("_to"))
    return (salted.join(rest, found, "left").withColumn(rank, F.coalesce("_f_rank", rank))
            .drop("_value", "_f_rank", "_salt", "_to", *[f"_{k}" for k in keys]))


def scaled(col: Column, low: Column, high: Column) -> Column:
    """Position of a value between two bounds, null when the bounds coincide."""
    return F.try_divide((col - low).cast("double"), high - low)


#: Parts of the map of bounds; a row searches one of them.
BOUND_PARTS = 256


def min_max(df: DataFrame, col: str, partition: Sequence[str] = (), name: str = "NORMALIZED", many: bool = False) -> DataFrame:
    """Min-max normalisation within each partition.

    The bounds of all partitions are one value that rows look up by key, so that no row moves, however large a partition is. For
    that they have to fit one value: with ``many`` partitions, more than some hundred thousand, the bounds are joined by key instead.
    A null key is a partition.
    """
    keys = list(partition)
    bounds = df.groupBy(*keys).agg(F.struct(F.min(col).alias("low"), F.max(col).alias("high")).alias("_bounds"))
    if not keys:
        joined = df.withColumn("_bounds", bounds.scalar())
    elif many:
        other = bounds.select(*[F.col(k).alias(f"_{k}") for k in keys], "_bounds")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        joined = df.join(other, same).drop(*[f"_{k}" for k in keys])
    else:
        key, part = F.struct(*keys), F.pmod(F.xxhash64(*keys), F.lit(BOUND_PARTS)).cast("int")
        parts = bounds.groupBy(part.alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(key.alias("key"), "_bounds"))).alias("held"))
        every = parts.agg(F.map_from_entries(F.collect_list(F.struct("part", "held"))).alias("all"))
        joined = df.withColumn("_bounds", F.element_at(F.element_at(every.scalar(), part), key))
    return joined.withColumn(name, scaled(F.col(col), F.col("_bounds.low"), F.col("_bounds.high"))).drop("_bounds")


def rankable(summary: DataFrame, aspect: str = "ASPECT", sentiment: str = "ASPECT_SENTIMENT") -> DataFrame:
    """The rows of an aspect summary that take part in the ranking: real aspects with a sentiment other than 0."""
    return summary.filter((F.col(sentiment) != 0) & ~F.col(aspect).isin("Generic", TOTAL))


def aspect_ranking(summary: DataFrame, by: Sequence[str] = (), k: int | None = 4, aspect: str = "ASPECT",
                   sentiment: str = "ASPECT_SENTIMENT", volume: str = "REVIEW_COUNT") -> DataFrame:
    """Aspects by low sentiment and high volume: ``(1 - sentiment) + 3 * volume``, both min-max scaled.

    Takes an aspect summary (a handful of rows per family), leaves out TOTAL, Generic and
    zero-sentiment rows, and ranks every family at once. ``ASPECT_RANKING`` ties take the largest
    rank; ``k`` rows per family are kept in rank order, aspect name breaking ties.
    """
    keys = list(by)
    rows = rankable(summary, aspect, sentiment)
    family = Window.partitionBy(*keys)

    def scale(c: str) -> Column:
        return scaled(F.col(c), F.min(c).over(family), F.max(c).over(family))

    points = SENTIMENT_WEIGHT * (1 - F.col("_sentiment")) + VOLUME_WEIGHT * F.col("_volume")
    reach = family.orderBy(F.desc_nulls_last("_points")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    place = Window.partitionBy(*keys).orderBy("ASPECT_RANKING", aspect)
    ranked = (rows.withColumns({"_sentiment": scale(sentiment), "_volume": scale(volume)})
              .withColumn("_points", points)
              .withColumn("ASPECT_RANKING", F.count(F.lit(1)).over(reach))
              .withColumn("PLACE", F.row_number().over(place).cast("long"))
              .drop("_sentiment", "_volume", "_points"))
    return ranked if k is None else ranked.filter(F.col("PLACE") <= k)


def top_aspects_by_count(summary: DataFrame, by: Sequence[str] = (), k: int = 4, aspect: str = "ASPECT") -> DataFrame:
    rows = summary.filter(F.col(aspect) != TOTAL)
    return first_rows(rows, list(by), [F.desc("REVIEW_COUNT"), F.asc(aspect)], k, "PLACE")


def order_desc(df: DataFrame, measure: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(measure), *ties)


def top_n(df: DataFrame, n: int, measure: str, *ties: str) -> DataFrame:
    """The n largest rows: Spark keeps n rows per task and merges them, without a full sort."""
    return order_desc(df, measure, *ties).limit(n)


def order_groups_by_volume(df: DataFrame, group: str, measure: str = "REVIEW_COUNT") -> DataFrame:
    """Rows ordered by the total volume of their group, the rows of a group staying together."""
    totals = df.groupBy(F.col(group).alias("_group")).agg(F.sum(measure).alias(f"{measure}_TOTAL"))
    return (df.join(totals, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
            .orderBy(F.desc(f"{measure}_TOTAL"), group, F.desc(measure)))


def recent_history(history: DataFrame, n: int = 4) -> DataFrame:
    """The n newest turns of each conversation."""
    return first_rows(history, ["conv_id"], [F.desc("turn")], n).drop("_rank")
