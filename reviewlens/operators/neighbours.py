"""Exact nearest neighbours over vector tables (Euclidean distance, ties by vector id)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from reviewlens.operators.blocks import BLOCK, match_blocks
from reviewlens.operators.grouping import first_rows
from reviewlens.sources.storage import cut_lineage


#: Pivots at most, and rows that are compared with them at a time.
MOST_PIVOTS, AT_ONCE = 4096, 1024
#: Numbers of a matrix that :func:`nearest` makes at a time.
VALUES = 1 << 21
#: Cells of a partition from which on they grow up to the size of a block.
CELLS = 256


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), AT_ONCE):
            yield batch.iloc[k:k + AT_ONCE]


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance) of the k nearest points of each query.

    One matrix product picks the candidates, with slack for its rounding; their distances are then
    computed from the differences, so equal vectors tie exactly. Queries are taken a few at a time, and so
    are differences, so that memory is bounded however many points there are and tie.
    """
    sizes = (points ** 2).sum(1)
    found = []
    for begin in range(0, len(queries), max(1, VALUES // len(points))):
        asked = queries[begin:begin + max(1, VALUES // len(points))]
        lengths = (asked ** 2).sum(1)
        rough = lengths[:, None] + sizes[None, :] - 2 * asked @ points.T
        kth = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        slack = 1e-9 * (lengths + sizes.max())
        rows, cols = np.nonzero(rough <= (kth + slack)[:, None])
        distance = np.empty(len(rows))
        piece = max(1, VALUES // max(1, points.shape[1]))
        for at in range(0, len(rows), piece):
            here = slice(at, at + piece)
            distance[here] = np.sqrt(((points[cols[here]] - asked[rows[here]]) ** 2).sum(1))
        order = np.lexsort((ids[cols], distance, rows))
        rows, cols, distance = rows[order], cols[order], distance[order]
        starts = np.searchsorted(rows, rows, side="left")
        keep = np.arange(len(rows)) - starts < k
        found.append((rows[keep] + begin, ids[cols[keep]], distance[keep]))
    return tuple(np.concatenate(p) for p in zip(*found))


def _result_type(queries: DataFrame, vectors: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("vec_id", vectors.schema["vec_id"].dataType),
        T.StructField("distance", T.DoubleType()),
    ])


def _top(found: DataFrame, k: int) -> DataFrame:
    return first_rows(found, ["query_id"], [F.asc("distance"), F.asc("vec_id")], k, "RANK")


def _block_matcher(k: int):
    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["query_id"][:0], "vec_id": right["vec_id"][:0],
                                 "distance": pd.Series(dtype=float)})
        rows, ids, distance = nearest(matrix(left["embedding"]), matrix(right["embedding"]),
                                      right["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[rows], "vec_id": ids, "distance": distance})
    return match


def knn(queries: DataFrame, vectors: DataFrame, k: int = 4, partition: str | None = None, block: int = 2048) -> DataFrame:
    """The k nearest vectors of each of a stated set of queries: ``query_id, vec_id, distance, RANK``.

    ``queries`` has ``query_id, embedding``, ``vectors`` has ``vec_id, embedding``. Blocks of ``block`` queries meet blocks of vectors
    in a task each, which hands on k rows a query; nothing passes through the driver. With ``partition`` a query only sees vectors
    with the same value of that column, by :func:`knn_large`, which is also the one to take for query tables of the size of the
    vectors.
    """
    if partition is not None:
        return knn_large(queries, vectors, k, partition)
    def one_cell(key: str):  # 0; a literal would turn the joins on it into joins without a key
        return F.pmod(F.xxhash64(key), F.lit(1)).alias("cell")

    found = match_blocks(queries.select(one_cell("query_id"), "query_id", "embedding"), vectors.select(one_cell("vec_id"), "vec_id", "embedding"), ["cell"],
                         "query_id", "vec_id", _block_matcher(k), _result_type(queries, vectors), left_rows=block)
    return _top(found, k)


def knn_large(queries: DataFrame, vectors: DataFrame, k: int = 4, partition: str | None = None,
              pivots: int | None = None, cell_rows: int = 4096) -> DataFrame:
    """Exact k nearest neighbours for large query and vector tables.

    Vectors belong to the cell of their nearest pivot, within their partition; there are as many pivots
    as the square root of the vectors, at most ``MOST_PIVOTS``, unless ``pivots`` says otherwise, and a partition uses as many of
    them as give it cells of about ``cell_rows`` vectors, or from ``CELLS`` cells on of more, up to a block. The distances from a
    query to the pivots bound its k-th neighbour from above and every cell from below (triangle
    inequality), so a query is sent only to cells that can hold one of its neighbours. Cells are
    matched in bounded blocks, whatever share of the vectors one of them holds.
    """
    spark = queries.sparkSession
    pivots = pivots or min(math.isqrt(vectors.count()) + 1, MOST_PIVOTS)
    chosen = (vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id")
              .limit(pivots).select("embedding").collect())
    result = _result_type(queries, vectors)
    if not chosen:
        return _top(spark.createDataFrame([], result), k)
    distinct = list(dict.fromkeys(tuple(r[0]) for r in chosen))
    centres = spark.sparkContext.broadcast(np.array(distinct, dtype=np.float64))

    def to_centres(points: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((points - one) ** 2).sum(1)) for one in centres.value], axis=1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            if not batch.empty:
                away = to_centres(matrix(batch["embedding"]))
                away[np.arange(away.shape[1])[None, :] >= batch["used"].to_numpy()[:, None]] = np.inf
                cell = away.argmin(1)
                yield batch.drop(columns="used").assign(cell=cell.astype("int32"), reach=away[np.arange(len(cell)), cell])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            for _, rows in batch.groupby("part", sort=False):
                cells, held, reach, kth = (np.array(rows[c].iloc[0], dtype=float) for c in ("cells", "held", "reach", "kth"))
                away = to_centres(matrix(rows["embedding"]))[:, cells.astype(int)]
                bound = np.minimum((away + kth).min(1), _enough(away + reach, held, k))
                hit = away - reach <= (bound * (1 + 1e-9) + 1e-9)[:, None]
                yield rows[["part", "query_id", "embedding"]].assign(cell=[cells[h].astype("int32") for h in hit])

    part = (F.lit(0) if partition is None else F.col(partition)).alias("part")
    inputs = vectors.select(part, "vec_id", "embedding").filter("part IS NOT NULL")
    used = inputs.groupBy("part").agg(
        F.least(F.lit(len(distinct)), F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(cell_rows), F.least(F.lit(BLOCK), F.floor(F.count(F.lit(1)) / CELLS))))).cast("int").alias("used"))
    asked = queries.select(part, "query_id", "embedding").filter("part IS NOT NULL")
    # Both are counted and then matched; writing them keeps the Python steps to one run each.
    placed = cut_lineage(inputs.join(used, "part").mapInPandas(place, T.StructType([
        *inputs.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())])))
    routed = cut_lineage(asked.join(_cell_reach(placed, k), "part").mapInPandas(
        route, T.StructType([*asked.schema.fields, T.StructField("cell", T.ArrayType(T.IntegerType()))])))
    # A query is written once with its cells; its copies are only made on the way to their blocks.
    routed = routed.withColumn("cell", F.explode("cell"))
    found = match_blocks(routed, placed.drop("reach"), ["part", "cell"], "query_id", "vec_id", _block_matcher(k), result)
    return _top(found, k)


def _enough(farthest: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """Per query, the distance within which whole cells hold k vectors; infinite when all hold fewer."""
    order = farthest.argsort(1)
    full = held[order].cumsum(1) >= k
    reached = np.take_along_axis(farthest, order, 1)[np.arange(len(order)), full.argmax(1)]
    return np.where(full.any(1), reached, np.inf)


def _cell_reach(placed: DataFrame, k: int) -> DataFrame:
    """One row per partition with its cells as arrays: number, vectors, farthest and k-th from the pivot.

    Every task sends at most k distances per cell it saw.
    """
    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[int, float, list[float]]] = {}
        for batch in batches:
            for key, reach in batch.groupby(["part", "cell"], sort=False)["reach"]:
                n, far, near = held.get(key, (0, 0.0, []))
                held[key] = (n + len(reach), max(far, reach.max()), sorted([*near, *reach.nsmallest(k)])[:k])
        yield pd.DataFrame([(*key, *found) for key, found in held.items()], columns=["part", "cell", "n", "far", "near"])

    parts = placed.select("part", "cell", "reach").mapInPandas(summary, T.StructType([
        placed.schema["part"], T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("far", T.DoubleType()), T.StructField("near", T.ArrayType(T.DoubleType()))]))
    cells = parts.groupBy("part", "cell").agg(
        F.sum("n").alias("held"),
        F.max("far").alias("reach"))
    near = first_rows(parts.select("part", "cell", F.explode("near").alias("kth")), ["part", "cell"], [F.asc("kth")], k, "_place")
    cells = cells.join(near.filter(F.col("_place") == k).select("part", "cell", "kth"), ["part", "cell"], "left").withColumn(
        "kth", F.coalesce("kth", F.lit(float("inf"))))
    # At most one entry per pivot.
    listed = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "held", "reach", "kth")).alias("all"))
    return listed.select("part", F.col("all.cell").alias("cells"), F.col("all.held").alias("held"),
                         F.col("all.reach").alias("reach"), F.col("all.kth").alias("kth"))
