"""Helpers of steps that work on Arrow batches: bounded pieces of a batch, and Bloom filters of a fixed size."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Bytes of text that a Python step works on at once.
STEP_BYTES = 4 << 20


def give_back() -> None:
    """Return freed memory to the system. A worker process lives on after its task, and would keep what its largest step took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            limit = (ends[begin - 1] if begin else 0) + most
            stop = max(begin + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop
    give_back()


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def bloom(keys: DataFrame, bits: int = 1 << 23) -> np.ndarray:
    """A Bloom filter with two probes over the column ``key`` (64-bit). Its size is fixed by ``bits``, a power of two up to 2^32,
    whatever the number of keys, so it can be sent to every task; a full one lets everything through, which costs time and no rows."""
    slot = F.explode(F.array(F.expr(f"key & {bits - 1}L"), F.expr(f"shiftrightunsigned(key, 32) & {bits - 1}L")))
    parts = (keys.select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("at"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
             .groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas())
    out = np.zeros(bits >> 6, np.uint64)
    out[parts["at"].to_numpy(np.int64)] = parts["bit"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bloom(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may have been put in."""
    low, place, bit = np.uint64(len(bitmap) * 64 - 1), np.uint64(6), np.uint64(63)

    def probe(slot):
        return (bitmap[(slot >> place).astype(np.int64)] >> (slot & bit)) & np.uint64(1) != 0

    found = probe(keys & low)
    at = np.flatnonzero(found)
    found[at] = probe((keys[at] >> np.uint64(32)) & low)
    return found
