"""Benchmark passages in training documents, found by spaced seeds.

A mask looks at some of the tokens of a span and ignores the others, so a substituted token leaves the seeds that skip it whole.
Seeds of documents and of benchmark items that agree put a document beside an item; around the hit, a window of ``WINDOW`` tokens
of which at least ``LEAST`` agree in place is an overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import bloom, hashed, in_bloom, mixed, seeds, steps, words
from reviewlens.sources.storage import cut_lineage

WINDOW, LEAST = 13, 10
#: Tokens that count (1) and tokens that are ignored (0), by the tokens of an item; longer items have those of WINDOW. Whichever
#: tokens of a window that overlaps differ, one of its masks fits on tokens that agree: ``tests/llm`` lays all of them.
MASKS = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "11011", "11101", "10111"), 6: ("100111", "11101"), 7: ("11011",),
    8: ("1111",), 9: ("10111", "10100101"), 10: ("11101", "11001001"), 11: ("10111",), 12: ("10100101",),
    WINDOW: ("1101111", "111010011", "1100010111", "11001100011", "11110101"),
}
DISTINCT = tuple(dict.fromkeys(mask for masks in MASKS.values() for mask in masks))
#: Stripped off the ends of a word.
MARKS = ".,;:!?\"'`()[]{}<>*#$%&|_-"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per text, and the hashes of all tokens: lower-case words without marks at their ends. A word of marks stays."""
    counts, index, distinct = words(texts)
    bare = pc.utf8_trim(pc.utf8_lower(distinct), MARKS)
    return counts, hashed(pc.if_else(pc.equal(pc.binary_length(bare), 0), distinct, bare))[index] if len(index) else np.zeros(0, np.uint64)


def seed_keys(coded: np.ndarray, counts: np.ndarray, numbers: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask, given by its place in DISTINCT: that, the places where it fits inside a text, and the hashes there."""
    ends = np.repeat(np.cumsum(counts), counts)
    weights = seeds(16, 3)
    for number in numbers:
        mask = DISTINCT[number]
        n = len(coded) - len(mask) + 1
        if n <= 0:
            continue
        looked = [k for k, c in enumerate(mask) if c == "1"]
        total = np.repeat(np.array([number + 1], np.uint64) * weights[-1], n)
        for w, k in zip(weights, looked):
            total += coded[k:k + n] * w
        at = np.flatnonzero(np.arange(n) + len(mask) <= ends[:n])
        yield number, at, mixed(total[at])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        counts, coded = tokens(batch.column("text"))
        starts = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(counts)), counts)
        for number, at, keys in seed_keys(coded, counts, range(len(DISTINCT))):
            sizes = [n for n, masks in MASKS.items() if DISTINCT[number] in masks]
            mine = np.isin(np.minimum(counts, WINDOW)[owner[at]], sizes)
            at, keys = at[mine], keys[mine]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(owner[at])), pa.array((at - starts[owner[at]]).astype(np.int32)), pa.array(keys.view(np.int64)),
                 pa.array(np.full(len(at), number, np.int32))], ["item_id", "item_at", "key", "mask"])


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        counts, coded = tokens(batch.column("text"))
        parts = np.split(coded, np.cumsum(counts)[:-1])
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([p.tobytes() for p in parts], pa.binary())], ["item_id", "item"])


def _stretches(bitmap: np.ndarray, numbers: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The stretches of a document around seeds that the benchmark may have: where each begins, its tokens, and the seeds."""
    reach = WINDOW + max(map(len, DISTINCT))

    def run(batches):
        for batch in steps(batches):
            counts, coded = tokens(batch.column("text"))
            found = [(at[hit], keys[hit]) for _, at, keys in seed_keys(coded, counts, numbers) for hit in [in_bloom(bitmap, keys)]]
            at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, keys = at[order], np.concatenate([k for _, k in found])[order]
            stops = np.cumsum(counts)
            owner = np.searchsorted(stops, at, side="right")
            cut = np.flatnonzero((np.diff(owner) > 0) | (np.diff(at) > 2 * reach)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
            docs = owner[first]
            begin = np.maximum(at[first] - reach, stops[docs] - counts[docs])
            stop = np.minimum(at[last - 1] + reach, stops[docs])
            lengths = last - first
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last]).astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array((at - np.repeat(begin, lengths)).astype(np.int32)), pa.array(keys.view(np.int64))], ["at", "key"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(docs)), pa.array((begin - (stops[docs] - counts[docs])).astype(np.int64)),
                 pa.array([coded[b:e].tobytes() for b, e in zip(begin, stop)], pa.binary()), listed],
                ["doc_id", "begin", "tokens", "seeds"])
    return run


def best_window(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Lay the item at ``shift`` (which may be negative) over the text. The stretch of windows that overlap: first token in the
    text, length, and agreeing tokens; None where no window does. An item shorter than a window is one window."""
    begin, stop = max(0, shift), min(len(text), shift + len(item))
    size = min(WINDOW, len(item))
    if stop - begin < size:
        return None
    same = np.concatenate([[0], np.cumsum(text[begin:stop] == item[begin - shift:stop - shift])])
    good = np.flatnonzero((same[size:] - same[:-size]) * WINDOW >= LEAST * size)
    if not len(good):
        return None
    return int(begin + good[0]), int(good[-1] + size - good[0]), int(same[good[-1] + size] - same[good[0]])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, found = [], []
        for i, (text, item, shift) in enumerate(zip(batch.column("tokens"), batch.column("item"), batch.column("shift").to_pylist())):
            best = best_window(np.frombuffer(text.as_buffer(), np.uint64), np.frombuffer(item.as_buffer(), np.uint64), shift)
            if best:
                keep.append(i)
                found.append(best)
        rows = batch.take(pa.array(keep, pa.int64()))
        begins, lengths, agreeing = (np.array([f[k] for f in found], np.int64) for k in range(3))
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("item_id"), pa.array(rows.column("begin").to_numpy() + begins), pa.array(lengths), pa.array(agreeing)],
            ["doc_id", "item_id", "first_token", "n_tokens", "n_agreeing"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Overlaps between ``docs`` (doc_id, text) and ``benchmark`` (item_id, text): one row for each document and item that overlap,
    with the longest one: first_token (in the document), n_tokens, n_agreeing. A null or empty text overlaps nothing; rows with the
    same id are one document. Extra columns are not looked at.

    Hashes are joined by Spark; a Bloom filter of a fixed size, made from the benchmark, spares the shuffle of seeds that it
    cannot have. What moves are short stretches of token hashes around hits, never texts.
    """
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    doc, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_seeds = cut_lineage(benchmark.mapInArrow(_item_seeds, f"item_id {item}, item_at int, key long, mask int").distinct())
    numbers = sorted(row["mask"] for row in item_seeds.select("mask").distinct().collect())  # at most DISTINCT
    item_seeds = item_seeds.drop("mask")
    items = benchmark.mapInArrow(_item_tokens, f"item_id {item}, item binary")
    stretches = docs.mapInArrow(_stretches(bloom(item_seeds), numbers), f"doc_id {doc}, begin long, tokens binary, seeds array<struct<at:int,key:long>>")
    stretches = cut_lineage(stretches.withColumn("stretch", F.monotonically_increasing_id()))
    hits = (stretches.select("stretch", F.inline("seeds")).join(item_seeds, "key")
            .select("stretch", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    laid = hits.join(stretches.select("stretch", "doc_id", "begin", "tokens"), "stretch").join(items, "item_id")
    found = laid.select("doc_id", "item_id", "begin", "tokens", "item", "shift").mapInArrow(
        _overlaps, f"doc_id {doc}, item_id {item}, first_token long, n_tokens long, n_agreeing long")
    best = F.max(F.struct("n_agreeing", "n_tokens", -F.col("first_token"))).alias("best")
    return (found.groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", (-F.col("best.col3")).alias("first_token"), "best.n_tokens", "best.n_agreeing"))
