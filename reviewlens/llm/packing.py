"""Best-fit-decreasing packing of groups of equal texts into shards of near equal bytes.

Groups are never divided. Sorted by size, each enters the shard with the least room that still holds it, found in a balanced
tree; the capacity is the smallest for which the wanted number of shards is enough. Small groups are packed first, in parallel
and by the same rule, into bundles of a fixed fraction of a shard; what the driver packs at the end are bundles and groups above
that fraction, whose number follows from the number of shards and of partitions and not from the rows.
A group larger than a fair share has a shard that is larger by as much, and no smaller shard can hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import partitions
from reviewlens.sources.storage import cut_lineage

#: Bundles that make up a shard.
FINENESS = 64


class Rooms:
    """The bins by room: a treap over (room, bin), whose heap order by a hash of the bin keeps its depth logarithmic."""

    def __init__(self):
        self.root = None

    def _split(self, node, key):
        """The nodes below ``key`` and the others; a node is [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            low, node[3] = None, node[3]
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def add(self, room: int, bin_: int) -> None:
        low, high = self._split(self.root, (room, bin_))
        self.root = self._merge(self._merge(low, [(room, bin_), hash((bin_ * 0x9E3779B97F4A7C15 + room * 0x85EBCA6B) & (2**61 - 1)), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room of at least ``size``, taken out."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node, above = high, None
        while node[2] is not None:
            node, above = node[2], node
        if above is None:
            high = node[3]
        else:
            above[2] = node[3]
        self.root = self._merge(low, high)
        return node[0]


def best_fit(sizes: Iterable[int], capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item under best-fit-decreasing, and the number of bins. Ties keep the order given. An item above the
    capacity has a bin of its own."""
    sizes = np.asarray(sizes, np.int64)
    bins, rooms, count = np.zeros(len(sizes), np.int64), Rooms(), 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        room, bin_ = rooms.take(size) or (max(capacity, size), count)
        count += bin_ == count
        bins[i] = bin_
        rooms.add(room - size, bin_)
    return bins, count


def fewest_bytes(sizes: Iterable[int], shards: int) -> np.ndarray:
    """The bins of the smallest capacity, found by halving, for which ``shards`` bins are enough."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return sizes
    low = max(int(sizes.max()), -(-int(sizes.sum()) // shards))
    high = low + int(sizes.max())  # always enough: were one more bin needed, every bin would be above the mean
    while low < high:
        middle = (low + high) // 2
        if best_fit(sizes, middle)[1] <= shards:
            high = middle
        else:
            low = middle + 1
    return best_fit(sizes, low)[0]


def _bundler(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        groups = pa.Table.from_batches(held).sort_by("key")
        bins, _ = best_fit(groups.column("bytes").to_numpy(), capacity)
        part = TaskContext.get().partitionId()
        yield from groups.append_column("bundle", pa.array((part << 32) + bins)).to_batches(max_chunksize=65536)
    return run


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Put every row into shards 0 to ``shards`` - 1 of near equal bytes; rows with equal texts share a shard.

    Returns doc_id, size (UTF-8 bytes of the text, plus 8), text_crc32, law ("bytes"), shard, slot (the place in its shard by
    doc_id, nulls first; gapless from 0) and grown_shard (null under this law). A null text counts as empty. Equal rows each have
    a slot. Shards may stay empty when there are fewer groups.
    Texts are only hashed where they are read; what is shuffled are ids, sizes and hashes.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = cut_lineage(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                                   F.unhex(F.sha2(text, 256)).alias("key"), F.monotonically_increasing_id().alias("uid")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    bundled = cut_lineage(groups.mapInArrow(_bundler(max(1, total // (shards * FINENESS))), "key binary, bytes long, bundle long"))
    bundles = bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy("bundle").toPandas()
    bins = fewest_bytes(bundles["bytes"], shards)
    placed = spark.createDataFrame(list(zip(bundles["bundle"].tolist(), bins.tolist())), "bundle long, shard int")
    found = rows.join(bundled.join(placed, "bundle").select("key", "shard"), "key")
    return numbered(found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "uid"))


def numbered(rows: DataFrame) -> DataFrame:
    """The column slot: the place of a row in its shard by (doc_id, uid). Ranges of rows are numbered on their own and moved up by
    what the ranges before hold, so that a shard may span any number of tasks."""
    order = [F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("uid")]
    laid = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    laid = cut_lineage(laid.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    spans = laid.groupBy("shard", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return (laid.withColumn("part", part).join(spans, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("at") + F.col("shift")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
