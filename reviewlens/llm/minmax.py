"""Near-duplicate documents by min-max hashing.

Every hash function orders the shingles of a set; both the least and the greatest value are kept, so that a signature of
``2 * FUNCTIONS`` values costs ``FUNCTIONS`` evaluations of each shingle. Documents whose signatures agree on a band of ``ROWS``
values are candidates, and a candidate counts when the full sets agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import bloom, components, hashed, in_bloom, mixed, seeds, steps, words
from reviewlens.operators.grouping import numbered
from reviewlens.sources.storage import cut_lineage

#: Words of a shingle.
SHINGLE = 5
#: Hash functions; each gives two values.
FUNCTIONS = 64
#: Values of a band. With 32 bands of 4, a pair at similarity 0.75 shares none with a chance of 5e-6.
ROWS = 4
BANDS = 2 * FUNCTIONS // ROWS


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashes of the shingles of each text: windows of ``SHINGLE`` words, or all words where there are fewer."""
    counts, index, distinct = words(texts)
    if not len(index):
        return [np.zeros(0, np.uint64)] * len(texts)
    coded = hashed(distinct)[index]
    weights = seeds(SHINGLE + 1, 1)
    padded = np.concatenate([coded, np.zeros(SHINGLE, np.uint64)])
    windows = padded[:len(coded)] * weights[0]
    for k in range(1, SHINGLE):
        windows += padded[k:k + len(coded)] * weights[k]
    windows = mixed(windows)
    sets, start = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            sets.append(np.unique(windows[start:start + n - SHINGLE + 1]))
        elif n:
            sets.append(mixed((coded[start:start + n] * weights[:n]).sum(keepdims=True) + np.array([n], np.uint64) * weights[-1]))
        else:
            sets.append(np.zeros(0, np.uint64))
        start += n
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit values per set, which must not be empty: 16 middle bits of the least and the greatest under each function
    in turn. Unequal values agree on them with a chance of 2^-16."""
    everything = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * FUNCTIONS), "<u2")
    for j, a in enumerate(seeds(FUNCTIONS, 2)):
        values = everything * a
        for k, reduce in enumerate((np.minimum, np.maximum)):
            out[:, 2 * j + k] = (reduce.reduceat(values, starts) >> np.uint64(32)) & np.uint64(0xFFFF)
    return out


def packed(hashes: np.ndarray) -> bytes:
    """A sorted set by the upper 48 bits of its hashes; two documents of 20,000 shingles share one by chance once in a million."""
    return (hashes >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data) -> np.ndarray:
    bytes_ = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(bytes_), 8), np.uint8)
    out[:, :6] = bytes_
    return out.view("<u8").ravel()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    for batch in steps(batches):
        sets = shingle_sets(batch.column("text"))
        filled = [s for s in sets if len(s)]
        rows = iter(signatures(filled)) if filled else iter(())
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
             pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
            ["doc_id", "text_hash", "n_shingles", "set_key", "signature"])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (a digest of the set; null where it is empty) and signature of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _sign, f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, signature binary")


#: A candidate whose signatures agree on fewer values is not looked at again. At similarity 0.75 the share has a standard
#: deviation of 0.04, so a link is missed here with a chance below 1e-6.
LEAST_AGREEMENT = 0.55
#: Members of a bucket that meet in one comparison.
SIDE = 1024


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
        yield batch.select(["a", "b"]).filter(pa.array((left == right).mean(1) >= LEAST_AGREEMENT)) if batch.num_rows else batch.select(["a", "b"])


def _linked(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                both = _shared(x, y)
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _cell_links(rows: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links of one cell between rows of side 0 and rows of side 1 of other components, as far as they join what the links before
    have not: at most one for each row. Pairs with agreeing signatures are compared in full, the most agreeing first."""
    side, nodes = rows.column("side").to_numpy(), rows.column("node").to_numpy()
    _, group = np.unique(rows.column("component").to_numpy(), return_inverse=True)
    sets = [unpacked(s.as_buffer()) for s in rows.column("shingles")]
    values = signatures([mixed(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    members = np.flatnonzero(side == 1)
    a, b = [], []
    for x in np.flatnonzero(side == 0):
        others = members[group[members] != group[x]]
        others = others[100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x])]
        agreeing = (values[others] == values[x]).mean(1)
        order = np.argsort(-agreeing, kind="stable")
        for y in others[order[:int((agreeing >= LEAST_AGREEMENT).sum())]]:
            if group[y] == group[x]:
                continue
            both = _shared(sets[x], sets[y])
            if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                a.append(int(nodes[x]))
                b.append(int(nodes[y]))
                group[group == group[y]] = group[x]
    return a, b


def _across(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of each cell. Cells come sorted; the one that a batch ends with is kept for the next batch."""
    def run(batches):
        held: list[pa.RecordBatch] = []

        def links():
            a, b = _cell_links(pa.Table.from_batches(held), percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
            for begin, stop in zip(bounds[:-1], bounds[1:]):
                if held and held[-1].column("cell")[-1].as_py() != cells[begin]:
                    yield links()
                    held = []
                held.append(batch.slice(begin, stop - begin))
        if held:
            yield links()
    return run


def _sets(bitmap: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        import xxhash
        for batch in batches:
            wanted = batch.filter(pa.array(in_bloom(bitmap, batch.column("key").to_numpy().view(np.uint64))))
            for rows in steps([wanted]):
                sets = shingle_sets(rows.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array([packed(s) for s in sets], pa.binary())], ["set_key", "shingles"])
    return run


def _band(signature: str) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                                 lambda k: F.xxhash64(k, F.substring(signature, k * (2 * ROWS) + 1, 2 * ROWS))))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Link documents whose shingle sets have ``100 * intersection >= percent * union`` and give each its component.

    Returns doc_id, n_shingles (size of the set), component_id (the smallest doc_id reachable), kept (it is its own component),
    text_hash and first (of the rows of the component, which may have this id with other texts, it is the one with the smallest id and
    then hash). Ids may be of any type that has an order. Documents without words have an empty set and are linked with nothing. Each
    row is a document with the links of its own text, also where an id occurs again; a null id is the smallest only where all are.
    Made for percent >= 75.

    1. Rows with equal sets form a class, whose node is its place by its smallest id; from here on a class is one row.
    2. Classes that share a band fall into a bucket. Each is compared with the smallest node of each of its buckets, and what is
       linked becomes a component.
    3. Buckets of three and more that still hold several components: every class outside the component of the smallest node meets
       every class of another component, in cells of ``SIDE`` by ``SIDE``, so no link between two classes of a bucket is left out
       and no bucket is one task. A cell returns the links that join components, at most one a row.
    """
    spark = docs.sparkSession
    rows = cut_lineage(signed(docs))
    smallest = lambda *c: F.min(F.when(F.col(c[0]).isNotNull(), F.struct(*c)))
    classes = numbered(rows.filter("set_key is not null").groupBy("set_key").agg(
        smallest("doc_id", "text_hash").alias("least"), F.first("signature").alias("signature")),
        [F.col("least.doc_id").asc_nulls_last(), F.col("least.text_hash")], "node")
    nodes = classes
    banded = nodes.select("node", _band("signature").alias("key"))
    pivots = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).filter("pivot < most").drop("most")
    buckets = cut_lineage(banded.join(pivots, "key").distinct())

    # The full set of a class is read off the text of its smallest row.
    members = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "set_key", F.xxhash64("least.doc_id", "least.text_hash").alias("key"))
    sets = docs.select("text", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.xxhash64("text"))).otherwise(F.xxhash64(F.lit(None).cast(docs.schema["doc_id"].dataType), F.lit(None).cast("long"))).alias("key")).mapInArrow(
        _sets(bloom(members)), "set_key binary, shingles binary")
    # One for each key before they meet the nodes, so that both steps share one shuffle of the sets.
    sets = cut_lineage(sets.filter("set_key is not null").groupBy("set_key").agg(F.first("shingles").alias("shingles"))
                       .join(members.select("node", "set_key"), "set_key").select("node", "shingles"))

    def both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        return (pairs.join(table.select(F.col("node").alias("a"), F.col(column).alias("sa")), "a")
                .join(table.select(F.col("node").alias("b"), F.col(column).alias("sb")), "b").select("a", "b", "sa", "sb"))

    def verified(pairs: DataFrame) -> DataFrame:
        return both(pairs, sets, "shingles").mapInArrow(_linked(percent), "a long, b long").distinct()

    stars = buckets.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    first = cut_lineage(verified(both(stars, nodes, "signature").mapInArrow(_agreeing, "a long, b long").distinct()))
    found = components(first, cut_lineage)

    placed = (buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
              .join(found.select(F.col("node").alias("pivot"), F.col("component").alias("main")), "pivot", "left")
              .select("key", "node", "component", (F.col("component") != F.coalesce("main", "pivot")).cast("int").alias("apart")))
    placed = cut_lineage(placed)
    counts = (placed.groupBy("key").agg(F.count("*").alias("m"), F.sum("apart").alias("u")).filter("u > 0 and m > 2")
              .select("key", F.ceil(F.col("m") / SIDE).cast("int").alias("m"), F.ceil(F.col("u") / SIDE).cast("int").alias("u")))
    apart = placed.join(counts, "key").join(sets, "node").select("key", "m", "u", "apart", "node", "component", "shingles")
    spread, own = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)), lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    kept = ("node", "component", "shingles")
    left = apart.filter("apart = 1").select("key", own("u").alias("x"), spread("m").alias("y"), F.lit(0).alias("side"), *kept)
    right = apart.select("key", spread("u").alias("x"), own("m").alias("y"), F.lit(1).alias("side"), *kept)
    cells = left.union(right).select(F.xxhash64("key", "x", "y").alias("cell"), "side", *kept)
    cells = cells.repartition("cell").sortWithinPartitions("cell")
    more = cells.mapInArrow(_across(percent), "a long, b long")
    # Components so far stand for their links.
    linked = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), cut_lineage)

    named = cut_lineage(classes.select("set_key", "least", "node").join(linked, "node", "left").select("set_key", "least", F.coalesce("component", "node").alias("component")))
    lowest = named.groupBy("component").agg(F.min("least").alias("lowest"))
    named = named.select("set_key", "component").join(lowest, "component").select("set_key", F.struct("lowest").alias("of"))
    out = rows.select("doc_id", "text_hash", "n_shingles", "set_key").join(named, "set_key", "left")
    # A row without words is its own component.
    component = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("of.lowest.doc_id"))
    first = F.col("of").isNull() | F.col("of.lowest").isNull() | (
        F.col("doc_id").eqNullSafe(F.col("of.lowest.doc_id")) & F.col("text_hash").eqNullSafe(F.col("of.lowest.text_hash")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", first.alias("first"))
