"""Token ids of documents in fixed-width bit-packed files, and the way back.

An id takes the least number of bits that the vocabulary needs. A file is a head, the offsets of its documents counted in ids,
the byte offset of each block of ``BLOCK`` ids, and the blocks; ids of any range are unpacked from the blocks that hold them
and no others. Files travel as the binary column of a Parquet table below the shared folder, so that Spark's committer settles
which attempt of a lost task counts and every store that Spark writes will do.
"""

from __future__ import annotations

import os
import struct
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import partitions, steps, words
from reviewlens.sources.storage import fresh_folder

MAGIC = b"RLTOKEN1"
HEAD = "<8sIIQQQ"
BLOCK = 1 << 16
#: Ids after which a file is closed at the next end of a document.
FILE_IDS = 4 << 20
#: Stands between words that go through the tokenizer together.
MARK = "\x01"
#: Words whose ids a worker remembers, from one task to the next.
REMEMBERED = 1 << 20
#: Words that are given to the tokenizer as one text.
TOGETHER = 1024


def width(vocabulary: int) -> int:
    """Bits for ids 0 to ``vocabulary`` - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive little-endian bit fields, filled up to a whole byte."""
    if bits == 16:  # the same bytes, directly
        return ids.astype("<u2").tobytes()
    fields = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(fields.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (fields.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_file(ids: np.ndarray, lengths: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """A file of documents with these many ids each."""
    blocks = [pack_bits(ids[i:i + block], bits) for i in range(0, len(ids), block)]
    documents = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = struct.pack(HEAD, MAGIC, bits, block, len(lengths), len(ids), len(blocks))
    return b"".join([head, documents.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Random access to the ids of a file."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.n_docs, self.n_ids, n_blocks = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, struct.calcsize(HEAD)).astype(np.int64)
        at = struct.calcsize(HEAD) + 8 * (self.n_docs + 1)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.body = memoryview(data)[at + 8 * (n_blocks + 1):]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1, from the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack_bits(self.body[self.offsets[k]:self.offsets[k + 1]], self.bits, min(self.block, self.n_ids - k * self.block))
                 for k in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block:stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class WordEncoder:
    """Encodes texts word by word, for a tokenizer that never joins characters across the white space of
    ``[\\x20\\x09-\\x0D]`` and drops it; each distinct word is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        marked = [self.encode_alone(t)[0].tolist() for t in (MARK, f"a {MARK} b", "a", "b")]
        if len(marked[0]) != 1 or marked[1] != marked[2] + marked[0] + marked[3]:
            raise ValueError("this tokenizer joins text across white space")
        self.mark = marked[0][0]
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number per word, for words without a mark: they go through the tokenizer many at a time."""
        bounds = pa.array(np.append(np.arange(0, len(distinct), TOGETHER), len(distinct)).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(bounds, distinct.cast(pa.string())), f" {MARK} ").to_pylist()
        ids, counts = [], []
        for found in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            got = np.array(found.ids, np.uint32)
            cuts = np.flatnonzero(got == self.mark)
            counts.append(np.diff(np.concatenate([[-1], cuts, [len(got)]])) - 1)
            ids.append(np.delete(got, cuts))
        return np.concatenate(ids), np.concatenate(counts)

    def encode_alone(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32)
        return ids, np.array([len(ids)])

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Encode and remember words; their places among those remembered. Words that hold a mark or a special token go alone."""
        odd = pc.match_substring(new, MARK)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(new, token))
        odd = odd.to_numpy(zero_copy_only=False)
        order = np.argsort(odd, kind="stable")
        plain, rare = new.take(pa.array(order[:len(new) - int(odd.sum())])), new.take(pa.array(order[len(new) - int(odd.sum()):]))
        parts = ([self.encode(plain)] if len(plain) else []) + [self.encode_alone(w) for w in rare.to_pylist()]
        place = np.empty(len(new), np.int64)
        place[order] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, plain, rare])
        self.ids = np.concatenate([self.ids, *(p[0] for p in parts)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([p[1] for p in parts]))])
        return place

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number per text."""
        counts, index, distinct = words(texts, lower=False)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        found = pc.index_in(distinct, value_set=self.known)
        place = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if found.null_count:
            place[place < 0] = self._learn(distinct.filter(pc.is_null(found)))
        place = place[index]
        begin, sizes = self.ends[place], self.ends[place + 1] - self.ends[place]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])]
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process. Steps travel by value, so what is to outlive a task is kept by the process."""
    memory = sys.modules.setdefault("reviewlens_worker", types.ModuleType("reviewlens_worker"))
    kept = vars(memory).setdefault("encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` added to each document."""
    return np.insert(ids, np.cumsum(lengths), end), lengths + 1


def packer(path: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encode = encoder(path)
        bits = width(encode.tokenizer.get_vocab_size())
        part, seq = TaskContext.get().partitionId(), 0
        held_ids, held_lengths, keys = [], [], []

        def file():
            ids, lengths = np.concatenate(held_ids), np.concatenate(held_lengths)
            key = pa.concat_arrays(keys)
            listed = pa.LargeListArray.from_arrays(pa.array([0, len(key)], pa.int64()), key)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), listed.cast(pa.list_(key.type)),
                 pa.array([write_file(ids, lengths, bits)], pa.binary())], ["part", "seq", "n_ids", "doc_ids", "data"])

        for batch in steps(batches):
            ids, lengths = with_end(*encode(batch.column("text")), end)
            held_ids.append(ids)
            held_lengths.append(lengths)
            keys.append(batch.column("doc_id"))
            if sum(map(len, held_ids)) >= FILE_IDS:
                yield file()
                held_ids, held_lengths, keys, seq = [], [], [], seq + 1
        if keys:
            yield file()
    return run


def write_tokens(docs: DataFrame, path: str, end: int, order: tuple = ("doc_id",), folder: str | None = None) -> DataFrame:
    """Encode the column ``text`` of every document, append ``end``, and write files in the order of the columns ``order``
    (then of the text; nulls first). A null text has only its end. Rows that are equal stay as many as they are.

    Returns the table of files as read back: part, seq, n_ids, doc_ids, data. Files of a lower (part, seq) come first.
    Texts are shuffled once, by ranges; a task holds one file at a time.
    """
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "tokens")
    keys = [F.col(f"o{i}").asc_nulls_first() for i in range(len(order))]
    chosen = docs.select("doc_id", "text", *(F.col(c).alias(f"o{i}") for i, c in enumerate(order))).withColumn("h", F.xxhash64("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    laid = chosen.repartitionByRange(partitions(spark), *keys, "h").sortWithinPartitions(*keys, "h").select("doc_id", "text")
    (laid.mapInArrow(packer(path, end), f"part int, seq int, n_ids long, doc_ids array<{kind}>, data binary")
     .write.mode("overwrite").option("compression", "uncompressed").parquet(folder))
    return spark.read.parquet(folder)


def _digests(batches):
    for batch in batches:
        for part, seq, keys, data in zip(*(batch.column(c) for c in ("part", "seq", "doc_ids", "data"))):
            file = TokenFile(data.as_buffer())
            starts, begin = file.starts, 0
            crcs = np.zeros(file.n_docs, np.int64)
            while begin < file.n_docs:  # a few blocks at a time
                stop = max(begin + 1, int(np.searchsorted(starts, starts[begin] + 8 * file.block, side="right")) - 1)
                raw = memoryview(file.ids(int(starts[begin]), int(starts[stop])).astype("<u4").tobytes())
                for k in range(begin, stop):
                    crcs[k] = zlib.crc32(raw[4 * (starts[k] - starts[begin]):4 * (starts[k + 1] - starts[begin])])
                begin = stop
            n = file.n_docs
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, seq.as_py(), np.int32)), keys.values,
                 pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs)],
                ["part", "seq", "doc_id", "begin", "n_tokens", "ids_crc32"])


def file_starts(files: DataFrame) -> DataFrame:
    """(part, seq, first): ids of all files before. Parts are summed first, so that the one window over all has a row a part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (files.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("n"))
            .join(totals, "part").select("part", "seq", (F.col("base") + F.col("n")).alias("first")))


def token_digests(files: DataFrame) -> DataFrame:
    """What the files hold of each document: doc_id, start (ids of all documents before it), n_tokens, and ids_crc32, the crc32
    of its ids as little-endian 32-bit integers. No files, no rows."""
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    rows = files.select("part", "seq", "doc_ids", "data").mapInArrow(
        _digests, f"part int, seq int, doc_id {kind}, begin long, n_tokens long, ids_crc32 long")
    return (rows.join(file_starts(files.select("part", "seq", "n_ids")), ["part", "seq"])
            .select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"))
