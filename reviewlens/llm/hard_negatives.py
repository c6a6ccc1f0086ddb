"""Hard negatives for anchors among vectors: rows of another label that score nearly as high as a positive.

Vectors are whole numbers, and scores are inner products of tiles of anchors and of candidates, multiplied by Strassen's recursion
on 64-bit integers, with zeros where a side is odd; its additions are exact. What a pair of tiles finds goes into heaps that can be
merged: the best rows of an anchor's own label (its positives), and, once those are known, for each positive the best rows of other
labels within a window of scores below its own.

Candidates are sorted by label and cut into tiles of ``TILE`` rows; ``STRIP`` tiles meet a tile of anchors in one task, which
merges their heaps. Tiles of anchors are sent for their positives only to the strips that hold a label of theirs, and for the
negatives to all strips but those of their one label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.grouping import first_rows, numbered
from reviewlens.sources.storage import cut_lineage

#: Rows of a tile of anchors and of one of candidates, and tiles of candidates that a task takes on.
ANCHORS, TILE, STRIP = 512, 2048, 4
#: Sides up to which tiles are multiplied row by column.
LEAF = 16
#: Components are multiplied by this and rounded down; those of this size and more count as not finite, so that 64 bits hold
#: every score of up to 16,384 dimensions.
SCALE, BOUND = 256, 1 << 15
#: A negative scores at least LEAST / OF of the positive, and at most as much.
LEAST, OF = 4, 5
LABELS = 10


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The inner products of the rows of ``a`` with the rows of ``b`` (int64)."""
    (m, k), n = a.shape, len(b)
    if min(m, k, n) <= leaf:
        return np.ascontiguousarray(a) @ np.ascontiguousarray(b).T
    if m & 1 or n & 1 or k & 1:
        a, b = (np.pad(x, ((0, len(x) & 1), (0, k & 1))) for x in (a, b))
    h, j, i = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b21, b12, b22 = b[:j, :i], b[:j, i:], b[j:, :i], b[j:, i:]  # by row of the transpose
    p = product(a11 + a22, b11 + b22, leaf)
    q = product(a21 + a22, b11, leaf)
    r = product(a11, b12 - b22, leaf)
    s = product(a22, b21 - b11, leaf)
    t = product(a11 + a12, b22, leaf)
    u = product(a21 - a11, b11 + b12, leaf)
    v = product(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p + s - t + v
    out[:h, j:] = r + t
    out[h:, :j] = q + s
    out[h:, j:] = p - q + r + u
    return out[:m, :n]


class Heaps:
    """The ``k`` first (score, id) of each of many owners: higher scores first, then smaller ids. Merging is adding."""

    def __init__(self, k: int):
        self.k, self.owner, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if self.ids is not None:
            owner, score, ids = np.concatenate([self.owner, owner]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        kept = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left") < self.k
        self.owner, self.score, self.ids = owner[kept], score[kept], ids[kept]


def firsts(scores: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` wanted cells of each row by score, then by column, however many are equal."""
    if scores.shape[1] <= k:
        return np.nonzero(wanted)
    masked = np.where(wanted, scores, np.iinfo(np.int64).min)
    floor = np.partition(masked, -k, axis=1)[:, -k][:, None]
    above = masked > floor
    level = (masked == floor) & wanted
    level &= np.cumsum(level, 1) <= k - above.sum(1, keepdims=True)
    return np.nonzero(above | level)


class Tile:
    """Rows of a packed tile. ``order`` lays them by id."""

    def __init__(self, row: dict):
        self.number = row["tile"]
        self.ids, self.labels = np.array(row["ids"], np.int64), np.array(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], "<i4").reshape(len(self.ids), -1).astype(np.int64)


def _packed(rows: pa.Table) -> pa.Table:
    """The rows of one tile, by label and id, as one row. Shorter vectors are filled up with zeros."""
    rows = rows.sort_by([("label", "ascending"), ("vec_id", "ascending")])
    vectors = rows.column("embedding").combine_chunks()
    sizes = vectors.value_lengths().to_numpy()
    flat = np.floor(vectors.flatten().to_numpy().astype(np.float64) * SCALE).astype("<i4")
    held = np.zeros((len(rows), int(sizes.max(initial=0))), "<i4")
    held[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    ids, labels = (rows.column(c).to_pylist() for c in ("vec_id", "label"))
    out = [[rows.column("tile")[0].as_py()], [ids], [labels], [held.tobytes()], [labels[0]], [labels[-1]]]
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(v, t) for v, t in zip(out, kinds)], ["tile", "ids", "labels", "vectors", "low", "high"])


_PACKED = "tile long, ids array<long>, labels array<long>, vectors binary, low long, high long"


def tiles(rows: DataFrame, size: int) -> DataFrame:
    """The rows sorted by label and cut into tiles."""
    laid = numbered(rows, [F.col("label"), F.col("vec_id"), F.xxhash64("embedding")], "at")
    return cut_lineage(laid.withColumn("tile", F.floor(F.col("at") / size)).select("tile", "vec_id", "label", "embedding")
                       .groupBy("tile").applyInArrow(_packed, _PACKED))


def _widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _runs(labels: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of equal labels in a tile."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
    for begin, stop in zip(cuts[:-1], cuts[1:]):
        if stop > begin:
            yield int(labels[begin]), slice(int(begin), int(stop))


def _positives(k: int):
    def run(anchors: pa.Table, strip: pa.Table) -> pa.Table:
        heaps = Heaps(k)
        number = 0
        for mine in map(Tile, anchors.to_pylist()):
            number = mine.number
            for other in map(Tile, strip.to_pylist()):
                runs = dict(_runs(other.labels))
                for label, rows in _runs(mine.labels):
                    if label not in runs:
                        continue
                    cols = runs[label]
                    scores = product(*_widened(mine.vectors[rows], other.vectors[cols]))
                    at, to = firsts(scores, mine.ids[rows][:, None] != other.ids[cols][None, :], k)
                    heaps.add(at + rows.start, scores[at, to], other.ids[cols][to])
        n = len(heaps.owner)
        return pa.table([pa.array(np.full(n, number, np.int64)), pa.array(heaps.owner), pa.array(heaps.score),
                         pa.array(heaps.ids if n else np.zeros(0, np.int64))], ["tile", "place", "score", "other"])
    return run


def _negatives(k: int, positives: int):
    def run(anchors: pa.Table, strip: pa.Table) -> pa.Table:
        heaps = Heaps(k)
        number = 0
        for row in anchors.to_pylist():
            mine, number = Tile(row), row["tile"]
            # Of the positives that an anchor has not, no score lies in the window.
            goal = np.full((len(mine.ids), positives), -1, np.int64)
            for place, rank, score in zip(row["places"], row["ranks"], row["scores"]):
                goal[place, rank - 1] = score
            low, high = np.where(goal >= 0, goal, np.iinfo(np.int64).max // OF).min(1), goal.max(1)
            for other in map(Tile, strip.to_pylist()):
                by_id = np.argsort(other.ids, kind="stable")
                ids, labels, vectors = other.ids[by_id], other.labels[by_id], other.vectors[by_id]
                for label, rows in _runs(mine.labels):
                    cols = np.flatnonzero(labels != label)
                    if not len(cols):
                        continue
                    scores = product(*_widened(mine.vectors[rows], vectors[cols]))
                    at, to = np.nonzero((OF * scores >= LEAST * low[rows][:, None]) & (scores <= high[rows][:, None]))
                    found = scores[at, to]
                    for j in range(positives):
                        bound = goal[rows][at, j]
                        inside = np.flatnonzero((OF * found >= LEAST * bound) & (found <= bound) & (bound >= 0))
                        heaps.add((at[inside] + rows.start) * positives + j, found[inside], ids[cols][to[inside]])
        n = len(heaps.owner)
        return pa.table([pa.array(np.full(n, number, np.int64)), pa.array(heaps.owner // positives), pa.array(heaps.owner % positives + 1),
                         pa.array(heaps.score), pa.array(heaps.ids if n else np.zeros(0, np.int64))], ["tile", "place", "positive", "score", "other"])
    return run


def _against(anchors: DataFrame, strips: DataFrame, pairs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` for each pair (anchor_tile, strip): its tile of anchors, and the tiles of candidates of the strip."""
    left = anchors.join(pairs, F.col("tile") == F.col("anchor_tile"))
    right = strips.join(pairs, "strip")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # new identities: both sides hold the same pairs
    return left.groupBy("anchor_tile", "strip").cogroup(right.groupBy("anchor_tile", "strip")).applyInArrow(
        lambda a, b: fn(a, b), schema)


def hard_negatives(vectors: DataFrame, every: int = 100, relabel: int = 7, positives: int = 5, negatives: int = 5,
                   anchor_rows: int = ANCHORS, tile_rows: int = TILE, strip: int = STRIP) -> DataFrame:
    """For each anchor (vec_id divisible by ``every``) and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels that score at least 80 of 100 of the positive and at most as much: anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score. Higher scores come first, then smaller ids.

    ``vectors`` has vec_id, embedding and label; extra columns are not looked at. Rows without a vec_id, label or vector, or with a
    component that is null, not finite or of BOUND or more, take no part. Where vec_id is divisible by ``relabel`` the label moves on by one,
    modulo 10. Shorter vectors count as filled up with zeros, so an empty one scores 0. Rows of one vec_id each take part, though not as positives of each other, and an anchor that occurs twice is
    answered twice. No rows give none.
    """
    known = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < {0})".format(BOUND)
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                           F.col("label").cast("long").alias("label"))
            .filter("vec_id is not null and label is not null and embedding is not null").filter(known)
            .withColumn("label", F.when(F.col("vec_id") % relabel == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))))
    candidates = tiles(rows, tile_rows).withColumn("strip", F.floor(F.col("tile") / strip))
    anchors = tiles(rows.filter(F.col("vec_id") % every == 0), anchor_rows)

    # Tiles lie in the order of labels, so those that hold a label, and their strips, follow each other.
    reach = candidates.select("strip", F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.min("strip").alias("first"), F.max("strip").alias("last"))
    own = (anchors.select(F.col("tile").alias("anchor_tile"), F.explode(F.array_distinct("labels")).alias("label")).join(reach, "label")
           .select("anchor_tile", F.explode(F.sequence("first", "last")).alias("strip")).distinct())
    found = _against(anchors, candidates, own, _positives(positives), "tile long, place long, score long, other long")
    best = cut_lineage(first_rows(found, ["tile", "place"], [F.desc("score"), F.asc("other")], positives, "positive"))

    # The strips that an anchor tile need not see have its one label only.
    spans = candidates.groupBy("strip").agg(F.min("low").alias("s_low"), F.max("high").alias("s_high"))
    last = candidates.agg(F.max("strip").alias("last"))
    goals = best.groupBy("tile").agg(*(F.collect_list(F.struct("place", "positive", "score")).alias("g"),)).select(
        "tile", F.col("g.place").alias("places"), F.col("g.positive").alias("ranks"), F.col("g.score").alias("scores"))
    asking = anchors.join(goals, "tile")
    all_pairs = (asking.select(F.col("tile").alias("anchor_tile"), "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), last.scalar())).alias("strip"))
                 .join(spans, "strip").filter("not (low = high and s_low = s_high and low = s_low)").select("anchor_tile", "strip"))
    window = _against(asking, candidates, all_pairs, _negatives(negatives, positives), "tile long, place long, positive long, score long, other long")
    chosen = first_rows(window, ["tile", "place", "positive"], [F.desc("score"), F.asc("other")], negatives, "rank")
    named = anchors.select("tile", F.posexplode("ids").alias("place", "anchor_id")).withColumn("place", F.col("place").cast("long"))
    return (chosen.withColumnsRenamed({"score": "negative_score", "other": "negative_id"})
            .join(best.withColumnsRenamed({"score": "positive_score", "other": "positive_id"}), ["tile", "place", "positive"])
            .join(named, ["tile", "place"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
