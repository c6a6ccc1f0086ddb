"""Ranked lexical search for many items at once, by common subexpressions.

The score of a document for an item is a sum over the item's terms, so items that have terms in common share parts of their sums.
The items of a block are mined for such sets: with the terms of each item in the order of how many items have them, the pairs of
neighbours that two or more items have become a new node, and so on with the nodes, until no pair is shared. The nodes form a
graph in which an item is the sum of a few nodes and each node the sum of two others. For a slice of documents the sums
of all nodes are made once, level by level, and every item adds up its own.

Texts are read once: what is kept of them are the occurrences of terms that some item may have (a Bloom filter of a fixed size
tells). Occurrences of a chunk of documents meet the graph of a block of items in a task of its own, which returns the few best
documents of each item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import bloom, hashed, in_bloom, partitions, steps, words
from reviewlens.operators.grouping import first_rows
from reviewlens.sources.storage import cut_lineage, fresh_folder

#: Items whose terms are mined and added up together.
BLOCK_ITEMS = 512
#: Sums (nodes x documents) that a task holds at a time.
SLICE_SUMS = 1 << 21
SCALE, SATURATION, FREE, SHARE = 1_000_000_000, 8, 10, 90

_TERM_BYTES = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM_BYTES[_low:_high + 1] = np.arange(_low, _high + 1)
_TERM_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of the texts, A-Z lower-cased: terms per text, the index of each
    into the distinct ones, and those. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    _, offsets, data = texts.buffers()
    mapped = _TERM_BYTES[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    return words(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(mapped), offset=texts.offset), lower=False)


# The graph of a block of items


class Graph:
    """How the sums of the items of a block are made. Nodes 0 to ``n_terms`` - 1 are terms that several items have; later ones are
    sums of two nodes, ``left`` and ``right``, with ``levels`` of nodes that need none of their own level or later. ``tops`` are the
    nodes that each item adds up (``top_starts`` where those of an item begin); ``own_items`` and ``own_terms`` the terms that one
    item alone has."""

    def __init__(self, items: Sequence[Iterable[int]]):
        lists = [sorted(set(i)) for i in items]
        having = Counter(t for own in lists for t in own)
        common = sorted((t for t, n in having.items() if n > 1), key=lambda t: (-having[t], t))
        node = {t: k for k, t in enumerate(common)}
        self.n_items, self.terms = len(lists), common
        self.own = [(k, t) for k, own in enumerate(lists) for t in own if having[t] == 1]
        self.pairs: list[tuple[int, int]] = []
        self._mine([sorted(node[t] for t in own if t in node) for own in lists])

    def _mine(self, lists: list[list[int]]) -> None:
        levels = [0] * len(self.terms)
        named: dict[tuple[int, int], int] = {}
        while True:
            seen = Counter(p for own in lists for p in zip(own, own[1:]))
            shared = {p: n for p, n in seen.items() if n > 1}
            if not shared:
                break
            taken: Counter = Counter()
            cut = []
            for own in lists:
                # The pair of most items first, then its neighbours on either side that do not overlap it.
                places = sorted((k for k in range(len(own) - 1) if (own[k], own[k + 1]) in shared), key=lambda k: (-shared[own[k], own[k + 1]], own[k], own[k + 1]))
                used, chosen = set(), set()
                for k in places:
                    if k not in used and k + 1 not in used:
                        used |= {k, k + 1}
                        chosen.add(k)
                        taken[own[k], own[k + 1]] += 1
                cut.append(chosen)
            # A pair that overlaps better ones everywhere but in one item would be a sum that nobody shares.
            if not any(n > 1 for n in taken.values()):
                break
            out = []
            for own, chosen in zip(lists, cut):
                row, k = [], 0
                while k < len(own):
                    pair = (own[k], own[k + 1]) if k in chosen else None
                    if pair is not None and taken[pair] > 1:
                        if pair not in named:
                            named[pair] = len(levels)
                            self.pairs.append(pair)
                            levels.append(1 + max(levels[pair[0]], levels[pair[1]]))
                        row.append(named[pair])
                        k += 2
                    else:
                        row.append(own[k])
                        k += 1
                out.append(row)
            lists = out
        self.tops, self.levels = lists, levels

    def arrays(self) -> dict[str, np.ndarray]:
        """The graph as arrays, nodes of pairs numbered by level."""
        n = len(self.terms)
        order = sorted(range(n, n + len(self.pairs)), key=lambda k: (self.levels[k], k))
        place = {**{k: k for k in range(n)}, **{k: n + i for i, k in enumerate(order)}}
        pairs = np.array([[place[c] for c in self.pairs[k - n]] for k in order], np.int64).reshape(-1, 2)
        return {
            "pairs": pairs, "level_sizes": np.bincount([self.levels[k] for k in order], minlength=1)[1:].astype(np.int64),
            "tops": np.array([place[k] for own in self.tops for k in own], np.int64), "top_sizes": np.array([len(own) for own in self.tops], np.int64),
            "own_items": np.array([k for k, _ in self.own], np.int64)}


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(data).read_all()
    return {k: np.frombuffer(table.column(k)[0].as_buffer(), np.int64) for k in table.column_names}


def _graphs(rows: pa.Table) -> pa.Table:
    """One block: its items (place and terms, with their weights) to a graph."""
    places, item = np.unique(rows.column("place").to_numpy(), return_inverse=True)
    keys, weights = rows.column("key").to_numpy(), rows.column("weight").to_numpy()
    distinct, first, term = np.unique(keys, return_index=True, return_inverse=True)
    lists: list[list[int]] = [[] for _ in places]
    for k, t in zip(item.tolist(), term.tolist()):
        lists[k].append(t)
    graph = Graph(lists)
    arrays = graph.arrays()
    common, own = np.array(graph.terms, np.int64), np.array([t for _, t in graph.own], np.int64)
    arrays |= {"places": places, "keys": distinct[common], "weights": weights[first][common], "own_keys": distinct[own], "own_weights": weights[first][own]}
    arrays["pairs"] = arrays["pairs"].ravel()
    return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int64()), "graph": pa.array([_packed(arrays)], pa.binary())})


# Documents


def _chunks(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(steps(batches)):
            counts, index, distinct = terms(batch.column("text"))
            keys = hashed(distinct)
            wanted = in_bloom(bitmap, keys)
            doc = np.repeat(np.arange(len(counts)), counts)
            kept = wanted[index]
            # One number for a document and a term, so that equal ones can be counted.
            width = max(1, len(distinct))
            cell, tf = np.unique(index[kept].astype(np.int64) + doc[kept] * width, return_counts=True)
            of, owner = cell % width, cell // width
            named, of = np.unique(of, return_inverse=True)
            order = np.argsort(of, kind="stable")
            held = np.bincount(of, minlength=len(named))
            ids = batch.column("doc_id")
            blobs = [counts.astype("<i8"), keys[named].astype("<u8"), held.astype("<i8"), owner[order].astype("<i4"), tf[order].astype("<i4")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 *(pa.array([pa.compress(b.tobytes(), codec="zstd", asbytes=True)], pa.binary()) for b in blobs),
                 pa.array([[len(counts), len(named), len(owner)]], pa.list_(pa.int64())), pa.array([int((counts > 0).sum())]), pa.array([int(counts.sum())])],
                ["chunk", "doc_ids", "counts", "keys", "held", "docs", "tfs", "sizes", "n_docs", "n_terms"])
    return run


def _opened(row: dict) -> tuple[np.ndarray, ...]:
    n, k, p = row["sizes"]
    kinds = (("counts", "<i8", n), ("keys", "<u8", k), ("held", "<i8", k), ("docs", "<i4", p), ("tfs", "<i4", p))
    return tuple(np.frombuffer(pa.decompress(row[c], size * int(t[-1]), codec="zstd", asbytes=True), t) for c, t, size in kinds)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a chunk that have each term."""
    for batch in batches:
        for row in batch.to_pylist():
            _, k, _ = row["sizes"]
            keys, held = (np.frombuffer(pa.decompress(row[c], 8 * k, codec="zstd", asbytes=True), t) for c, t in (("keys", "<i8"), ("held", "<i8")))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(held)], ["key", "df"])


def item_sums(graph: dict[str, np.ndarray], impact, n_docs: int) -> np.ndarray:
    """The sums of every item for documents 0 to ``n_docs`` - 1; ``impact(keys, weights)`` gives (row, document, value) of the
    occurrences of these terms. All additions are of 64-bit integers."""
    n_terms = len(graph["keys"])
    pairs = graph["pairs"].reshape(-1, 2)
    sums = np.zeros((n_terms + len(pairs), n_docs), np.int64)
    row, doc, value = impact(graph["keys"], graph["weights"])
    sums[row, doc] = value
    at = n_terms
    for size in graph["level_sizes"]:
        part = pairs[at - n_terms:at - n_terms + size]
        np.add(sums[part[:, 0]], sums[part[:, 1]], out=sums[at:at + size])
        at += int(size)
    top_sizes = graph["top_sizes"]
    out = np.zeros((len(top_sizes), n_docs), np.int64)
    some = np.flatnonzero(top_sizes)
    if len(some):
        starts = (np.cumsum(top_sizes) - top_sizes)[some]
        out[some] = np.add.reduceat(sums[graph["tops"]], starts, axis=0)
    row, doc, value = impact(graph["own_keys"], graph["own_weights"])
    np.add.at(out, (graph["own_items"][row], doc), value)
    return out


def _best(k: int, n_all: int, l_all: int):
    """The ``k`` best documents of each item of a block in each chunk. A document below the k-th score that a task has already seen
    for an item is left out: that many better ones are on their way."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[dict, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.select(["block", "graph", "counts", "keys", "held", "docs", "tfs", "sizes"]).to_pylist()[0]
                if row["block"] not in kept:
                    kept.clear()  # rows come by block
                    graph = _unpacked(row["graph"])
                    kept[row["block"]] = graph, np.ones((len(graph["places"]), k), np.int64)
                graph, floor = kept[row["block"]]
                counts, keys, held, docs, tfs = _opened(row)
                # Documents of the chunk in the order of their ids, nulls last, so that of equal scores the first is taken.
                ids = one.column("doc_ids").values[one.column("doc_ids").offsets[0].as_py():one.column("doc_ids").offsets[1].as_py()]
                rank = pc.sort_indices(ids, null_placement="at_end").to_numpy().astype(np.int64)
                place = np.empty(len(rank), np.int64)
                place[rank] = np.arange(len(rank))
                docs = place[docs]
                length = (100 - SHARE) + SHARE * counts[rank] * n_all // max(1, l_all)
                order = np.argsort(keys, kind="stable")
                starts = np.cumsum(held) - held
                found_items, found_docs, found_scores = [], [], []
                step = max(1, SLICE_SUMS // max(1, len(graph["keys"]) + len(graph["pairs"]) // 2 + len(graph["places"])))
                for begin in range(0, len(ids), step):
                    stop = min(len(ids), begin + step)

                    def impact(wanted, weights):
                        at = np.searchsorted(keys[order], wanted.view(np.uint64))
                        at = order[np.minimum(at, len(order) - 1)] if len(order) else np.zeros(len(wanted), np.int64)
                        hit = np.flatnonzero(keys[at] == wanted.view(np.uint64)) if len(keys) else np.zeros(0, np.int64)
                        sizes = held[at[hit]] if len(hit) else np.zeros(0, np.int64)
                        total = np.cumsum(sizes)
                        where = np.repeat(starts[at[hit]] - (total - sizes), sizes) + np.arange(total[-1]) if len(hit) else np.zeros(0, np.int64)
                        rows = np.repeat(hit, sizes)
                        doc, tf = docs[where], tfs[where].astype(np.int64)
                        inside = np.flatnonzero((doc >= begin) & (doc < stop))
                        rows, doc, tf = rows[inside], doc[inside], tf[inside]
                        return rows, doc - begin, weights[rows] * (SCALE * tf // (1000 * tf + SATURATION * length[doc]))

                    sums = item_sums(graph, impact, stop - begin)
                    item, doc = np.nonzero(sums >= floor[:, :1])
                    if not len(item):
                        continue
                    score = sums[item, doc]
                    chosen = np.lexsort((doc, -score, item))
                    item, doc, score = item[chosen], doc[chosen] + begin, score[chosen]
                    first = np.arange(len(item)) - np.searchsorted(item, item, side="left") < k
                    item, doc, score = item[first], doc[first], score[first]
                    # The k best scores so far, the lowest in front.
                    spread = np.zeros((len(floor), k), np.int64)
                    spread[item, np.arange(len(item)) - np.searchsorted(item, item, side="left")] = score
                    floor[:] = np.maximum(1, np.sort(np.concatenate([floor, spread], 1), axis=1)[:, -k:])
                    found_items.append(item)
                    found_docs.append(doc)
                    found_scores.append(score)
                if found_items:
                    item, doc, score = (np.concatenate(p) for p in (found_items, found_docs, found_scores))
                    good = score >= floor[item, 0]
                    item, doc, score = item[good], doc[good], score[good]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(graph["places"][item]), ids.take(pa.array(rank[doc])), pa.array(score)], ["place", "doc_id", "score"])
    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        counts, index, distinct = terms(batch.column("text"))
        owner = np.repeat(np.arange(len(counts)), counts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("place").take(pa.array(owner)), pa.array(hashed(distinct).view(np.int64)[index] if len(index) else np.zeros(0, np.int64))], ["place", "key"])


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The ``k`` documents of ``docs`` (doc_id, text) with the highest score above 0 for each item of ``items`` (item_id, text):
    item_id, rank (from 1), doc_id, score. Equal scores are in the order of doc_id.

    With N documents that have a term, L terms in all, and df documents that have a term, its weight w is
    floor(1000 ln((2N + 2) / (2df + 1))); a document with n terms, tf of them this one, gets w * (10^9 tf div (1000 tf + 8m)) with
    m = 10 + 90nN div L, summed over the item's distinct terms. A null or empty text has no terms. Rows of ``items`` with the same
    item_id, null included, are one item with the terms of all. Rows of ``docs`` each are a document, equal ones too; those without
    a doc_id count in all figures and come last among equal scores. Extra columns are not looked at. Without items or documents
    there are no rows.

    Items are dealt to blocks by a hash, and every chunk of documents meets every block; the driver sees three numbers.
    """
    spark = docs.sparkSession
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    items = items.select("item_id", "text")
    # An item is known by a hash of its id from here on; the table of both is joined back at the end.
    names = cut_lineage(items.select("item_id", F.xxhash64("item_id", F.col("item_id").isNull()).alias("place")).distinct())
    asked = cut_lineage(items.select(F.xxhash64("item_id", F.col("item_id").isNull()).alias("place"), "text")
                        .mapInArrow(_item_terms, "place long, key long").distinct())
    blocks = max(1, -(-names.count() // block_items))

    folder = fresh_folder(spark, "occurrences")
    (docs.select("doc_id", "text").mapInArrow(
        _chunks(bloom(asked.select("key"))),
        f"chunk long, doc_ids array<{doc_kind}>, counts binary, keys binary, held binary, docs binary, tfs binary, sizes array<long>, n_docs long, n_terms long")
     .write.option("compression", "uncompressed").parquet(folder))
    chunks = spark.read.parquet(folder)
    n_all, l_all = chunks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    vocabulary = asked.select("key").distinct()
    frequency = (chunks.select("keys", "held", "sizes").mapInArrow(_held, "key long, df long")
                 .join(vocabulary, "key", "left_semi").groupBy("key").agg(F.sum("df").alias("df")))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_all + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(frequency.select("key", weight.alias("weight")), "key").withColumn("block", F.pmod("place", F.lit(blocks)))
    graphs = weighted.groupBy("block").applyInArrow(_graphs, "block long, graph binary")

    # Every chunk meets every block. A block is copied to as many keys as there are partitions, so that no task gets all chunks.
    salts = partitions(spark)
    every = chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)))
    copies = graphs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = every.join(copies, ["block", "salt"]).select("block", "graph", "doc_ids", "counts", "keys", "held", "docs", "tfs", "sizes")
    found = met.mapInArrow(_best(k, int(n_all), int(l_all)), f"place long, doc_id {doc_kind}, score long")
    best = first_rows(found, ["place"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], k, "rank")
    return (best.join(names, "place").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
