"""Approximate nearest neighbours: a stored index of inverted lists over learnt centres.

A vector belongs to the list of its nearest centre, and a question looks into the lists of the centres nearest to it. Centres are
learnt from a bounded sample, so their number does not grow with the table beyond ``MOST_LISTS``; how many lists a question looks
into is measured on the sample when the index is built, for the recall that is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from reviewlens.operators.blocks import match_blocks
from reviewlens.operators.neighbours import _block_matcher, _parts, _result_type, _top, matrix
from reviewlens.sources.snapshots import read_table, upsert
from reviewlens.sources.storage import cut_lineage

#: Vectors that centres are learnt from (in the order of a hash of their ids), vectors that lists are tried with, and rounds.
FIT_VECTORS, TRIED, ROUNDS = 16_384, 512, 10
#: Centres at most.
MOST_LISTS = 512


def _away(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, up to what is the same for all centres."""
    return (centres ** 2).sum(1)[None, :] - 2 * points @ centres.T


def learn(points: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Centres by Lloyd's rounds. A centre without points stays where it is."""
    centres = points[np.random.default_rng(seed).permutation(len(points))[:n]].copy()
    for _ in range(ROUNDS):
        own = _away(points, centres).argmin(1)
        held = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def probes_for(points: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Lists that hold this share of the k nearest of points of the sample, the point itself apart."""
    asked = points[:TRIED]
    own = _away(points, centres).argmin(1)
    rank = _away(asked, centres).argsort(1).argsort(1)
    away = _away(asked, points)
    away[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    nearest = away.argsort(1)[:, :min(k, len(points) - 1)]
    found = np.sort(np.take_along_axis(rank, own[nearest], 1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 1 if len(found) else 1


def _placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # at most MOST_LISTS centres

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            if len(batch):
                yield batch.assign(list=_away(matrix(batch["embedding"]), shared.value).argmin(1).astype("int32"))
    chosen = vectors.select("vec_id", "embedding").filter("embedding IS NOT NULL")
    return chosen.mapInPandas(place, T.StructType([*chosen.schema.fields, T.StructField("list", T.IntegerType())]))


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # at most MOST_LISTS
    return np.array([r["centre"] for r in rows], dtype=np.float64), rows[0]["probes"]


def build_lists(vectors: DataFrame, path: str, list_rows: int = 1024, k: int = 4, recall: float = 0.95) -> None:
    """Learn lists of about ``list_rows`` vectors and store the vectors (vec_id, embedding) in them."""
    n = vectors.filter("embedding IS NOT NULL").count()
    if not n:
        raise ValueError("lists are learnt from vectors, and there are none")
    sample = vectors.filter("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_VECTORS).select("embedding").toPandas()
    points = matrix(sample["embedding"])
    centres = learn(points, min(MOST_LISTS, len(points), -(-n // list_rows)))
    probes = probes_for(points, centres, k, recall)
    rows = [(i, [float(x) for x in c], probes) for i, c in enumerate(centres)]
    vectors.sparkSession.createDataFrame(rows, "list int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
    append_lists(vectors, path)


def append_lists(vectors: DataFrame, path: str) -> int:
    """Add vectors to a stored index, under the centres that it has; a vector with a known id takes the place of that one, so the same
    vectors added again change nothing."""
    centres, _ = _centres(vectors.sparkSession, path)
    return upsert(_placed(vectors, centres), f"{path}/lists", "vec_id")


def knn_lists(queries: DataFrame, path: str, k: int = 4, probes: int | None = None) -> DataFrame:
    """Approximately the k nearest stored vectors of each query (query_id, embedding): ``query_id, vec_id, distance, RANK``.

    A query meets the vectors of its ``probes`` nearest lists, as many as the index was tried with by default, in bounded blocks.
    Distances are exact, so a vector that is found is in its right order.
    """
    spark = queries.sparkSession
    centres, tried = _centres(spark, path)
    shared, wanted = spark.sparkContext.broadcast(centres), min(probes or tried, len(centres))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            if len(batch):
                near = _away(matrix(batch["embedding"]), shared.value).argsort(1, kind="stable")[:, :wanted]
                yield batch.assign(list=list(near.astype("int32")))

    stored = read_table(spark, f"{path}/lists")
    asked = queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
    # A query is written once with its lists; its copies are only made on the way to their blocks.
    routed = cut_lineage(asked.mapInPandas(route, T.StructType([*asked.schema.fields, T.StructField("list", T.ArrayType(T.IntegerType()))])))
    found = match_blocks(routed.withColumn("list", F.explode("list")), stored, ["list"], "query_id", "vec_id", _block_matcher(k), _result_type(queries, stored))
    return _top(found, k)
