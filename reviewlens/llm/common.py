"""Helpers shared by the operators: reading, splitting into words, hashing; and, from the library, Bloom filters and components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.arrow import STEP_BYTES, bloom, in_bloom, mixed, steps  # noqa: F401
from reviewlens.operators.graphs import components  # noqa: F401

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """The caller's setting for the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5. A null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts: words per text, index of each word into the distinct words, and those.
    A null text has none."""
    # A fresh copy: ascii_lower misreads texts whose buffer begins before their first row, as slices have it.
    texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = split.flatten()
    kept = pc.greater(pc.binary_length(flat), 0)
    owner = pc.list_parent_indices(split).filter(kept).to_numpy()
    coded = flat.filter(kept).dictionary_encode()
    return np.bincount(owner, minlength=len(texts)), coded.indices.to_numpy(), coded.dictionary


def hashed(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    import xxhash
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


def seeds(count: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers from a counter."""
    return mixed((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 20)) * GOLDEN) | np.uint64(1)
