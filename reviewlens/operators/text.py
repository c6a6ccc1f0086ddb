"""Chunking and embedding of texts, and vector tables built from them."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from reviewlens.functions.arrow import steps
from reviewlens.sources.snapshots import upsert
from reviewlens.sources.tables import write_vectors

# Where a text may be cut, best place first.
CUTS = ("\n\n", "\n", " ", "")


def _pieces(text: str, cut: str) -> list[str]:
    """The text split before each separator; the empty separator splits letters."""
    if not cut:
        return list(text)
    head, *tail = text.split(cut)
    return [p for p in (head, *(cut + t for t in tail)) if p]


def _pack(pieces: Sequence[str], size: int, overlap: int) -> list[str]:
    """Join pieces into chunks of at most ``size`` characters. A chunk begins with the last whole
    pieces of the one before it, as far as they fit into ``overlap``."""
    chunks: list[str] = []
    held: deque[str] = deque()
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            chunks.append("".join(held))
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.popleft())
        held.append(piece)
        length += len(piece)
    if held:
        chunks.append("".join(held))
    return chunks


def split_text(text: str, size: int = 10_000, overlap: int = 200, cuts: Sequence[str] = CUTS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at paragraphs, else lines, else spaces, else letters."""
    at = next(i for i, c in enumerate(cuts) if not c or c in text)
    out: list[str] = []
    run: list[str] = []
    for piece in _pieces(text, cuts[at]):
        if len(piece) <= size:
            run.append(piece)
            continue
        out += _pack(run, size, overlap)
        run = []
        out += split_text(piece, size, overlap, cuts[at + 1:])
    out += _pack(run, size, overlap)
    return [c for c in (chunk.strip() for chunk in out) if c]


def chunk_text(df: DataFrame, col: str, size: int = 10_000, overlap: int = 200, chunk: str = "chunk") -> DataFrame:
    """One row per chunk: the other columns, ``chunk_no`` from 0, and the chunk."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    kept = [f for f in df.schema.fields if f.name != col]
    schema = T.StructType([*kept, T.StructField("chunk_no", T.IntegerType()), T.StructField(chunk, T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A few megabytes of text at a time, whatever a batch holds: its chunks are copies of it.
        for batch in steps(batches, col):
            parts = [split_text(t, size, overlap) if t else [] for t in batch.column(col).to_pylist()]
            counts = [len(p) for p in parts]
            rows = pa.array(np.repeat(np.arange(len(parts)), counts))
            numbers = pa.array(np.concatenate([np.arange(n, dtype="int32") for n in counts]))
            chunks = pa.array([c for p in parts for c in p], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(rows) for f in kept), numbers, chunks], schema.names)

    return df.select(*[f.name for f in kept], col).mapInArrow(cut, schema)


def fixed_windows(df: DataFrame, col: str, size: int = 10_000, overlap: int = 200, chunk: str = "chunk") -> DataFrame:
    """One row per window of ``size`` characters, each beginning ``overlap`` before the end of the one before it: the other columns,
    ``chunk_no`` from 0, and the window, with SQL functions only. Empty and null texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.char_length(col) - size) / step)).cast("int")
    kept = [F.col(c) for c in df.columns if c != col]
    cut = df.filter(F.char_length(col) > 0).select(*kept, F.col(col).alias("_text"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return cut.select(*kept, "chunk_no", F.substring("_text", F.col("chunk_no") * step + 1, F.lit(size)).alias(chunk))


def embed(df: DataFrame, col: str, embedder: Callable[[pd.Series], Sequence] | None = None, dims: int = 256,
          out: str = "embedding") -> DataFrame:
    """Add an embedding column.

    ``embedder`` maps a series of texts to a sequence of float vectors and runs on Arrow batches.
    Without one, texts become unit vectors of hashed word counts: nothing is fitted, so a text has the
    same vector in every table, and a question can be asked of a stored one. No words, the zero vector.
    """
    if embedder is not None:
        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([np.asarray(v, dtype=np.float32) for v in embedder(texts)])
        return df.withColumn(out, run(F.col(col)))

    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.withColumn("_words", F.filter(
        F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0))
    counts = HashingTF(numFeatures=dims, inputCol="_words", outputCol="_counts").transform(words)
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counts)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")


def vector_table(chunks: DataFrame, key: Sequence[str], text: str = "chunk") -> DataFrame:
    """``vec_id, embedding, text, metadata`` from embedded chunks; the id is a hash of the key columns."""
    pairs = [part for k in key for part in (F.lit(k), F.col(k).cast("string"))]
    return chunks.select(F.xxhash64(*key).alias("vec_id"), "embedding", F.col(text).alias("text"),
                         F.create_map(*pairs).alias("metadata"))


def build_index(df: DataFrame, path: str, key: Sequence[str], col: str, size: int = 10_000, overlap: int = 200,
                embedder: Callable[[pd.Series], Sequence] | None = None, mode: str = "append") -> None:
    """Chunk, embed and store texts as a vector table; append mode extends an existing one."""
    chunks = chunk_text(df.select(*key, col), col, size, overlap)
    write_vectors(vector_table(embed(chunks, "chunk", embedder), [*key, "chunk_no"]), path, mode)


def extend_index(df: DataFrame, path: str, key: Sequence[str], col: str, size: int = 10_000, overlap: int = 200,
                 embedder: Callable[[pd.Series], Sequence] | None = None) -> int:
    """Chunk and embed texts and put them into a stored vector table by id: a chunk takes the place of the one with its key and number,
    so a run that is repeated changes nothing, and readers (``snapshots.read_table``) see whole versions. Returns the version."""
    chunks = chunk_text(df.select(*key, col), col, size, overlap)
    table = vector_table(embed(chunks, "chunk", embedder), [*key, "chunk_no"])
    # Maps have no order, and a hash only on request; the pairs of keys and values have both.
    listed = table.withColumn("metadata", F.map_entries("metadata"))
    return upsert(listed, path, "vec_id")


def union_index(*tables: DataFrame) -> DataFrame:
    """Several vector tables as one; ``origin`` tells them apart."""
    first, *rest = [t.withColumn("origin", F.lit(i)) for i, t in enumerate(tables)]
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first


def ask(questions: DataFrame, index: DataFrame, k: int = 4, question: str = "question", query_id: str = "query_id",
        embedder: Callable[[pd.Series], Sequence] | None = None, dims: int = 256) -> DataFrame:
    """The k chunks of a vector table nearest to each question: ``query_id, vec_id, distance, RANK, text``. The questions are embedded
    as the index was."""
    from reviewlens.operators.neighbours import knn
    asked = embed(questions.select(F.col(query_id).alias("query_id"), question), question, embedder, dims).select("query_id", "embedding")
    return knn(asked, index, k).join(index.select("vec_id", "text"), "vec_id")
