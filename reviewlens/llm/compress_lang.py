"""The language of a text by compression: the text is compressed with one zstandard raw-content dictionary for each language, and
the language whose dictionary makes it smallest is the answer. Where the runner-up is nearly as small, the answer is rejected.

A dictionary is a bounded sample of labelled texts, laid end to end. A dictionary reaches only so far into a text, and a long text
soon resembles itself more than any dictionary, so texts are compressed in pieces that are added up; whole texts count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import steps
from reviewlens.operators.grouping import first_rows

#: The sample of a language: at most so many distinct texts, in the order of a hash of them, and of each at most so many characters,
#: from a place that the hash settles. All of a language together have at most FIT_ALL characters, dealt evenly.
FIT_TEXTS, FIT_CHARS, FIT_ALL = 1024, 2048, 1 << 18
#: Bytes of a piece, and the level of the compressor.
PIECE, LEVEL = 1024, 5
#: An answer whose size is within this share of the runner-up's is rejected.
MARGIN = 0.02
#: The name of no language.
UNKNOWN = "und"


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def letters(texts: pa.Array) -> pa.Array:
    """Lower-case texts with one space for all between letters, and at both ends; null where there is no letter."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    found = pc.match_substring_regex(texts, r"\p{L}")
    space, nothing = (pa.scalar(c, pa.large_string()) for c in (" ", ""))
    spaced = pc.replace_substring_regex(pc.binary_join_element_wise(space, pc.utf8_lower(texts), space, nothing), r"[^\p{L}\p{M}]+", " ")
    return pc.if_else(found, spaced, pa.scalar(None, pa.large_string()))


def compressors(samples: Mapping[str, bytes]) -> dict:
    """A compressor for each language, by name. It writes no sizes, sums or ids, so only the content counts."""
    import zstandard
    out = {}
    for lang in sorted(samples):
        held = zstandard.ZstdCompressionDict(samples[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        out[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
    return out


def sizes(text: bytes, by_language: Mapping) -> list[int]:
    """Compressed bytes of the text under each language."""
    pieces = [text[k:k + PIECE] for k in range(0, len(text), PIECE)]
    return [sum(len(c.compress(p)) for p in pieces) for c in by_language.values()]


def _classifier(samples: Mapping[str, bytes], margin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        by_language = compressors(samples)
        names = list(by_language)
        for batch in steps(batches):
            best, score = [], []
            for text in letters(batch.column("text")).cast(pa.large_binary()):
                if not text.is_valid or not names:
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                found = sizes(text.as_py(), by_language)
                first = min(range(len(found)), key=found.__getitem__)  # the first name of several that are as small
                others = found[:first] + found[first + 1:]
                best.append(names[first])
                score.append(1.0 - found[first] / min(others) if others else 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64()),
                 pa.array(np.array(score, float) < margin)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])
    return run


def fit(docs: DataFrame) -> dict[str, bytes]:
    """The dictionaries, from rows of ``docs`` (text, lang) with a language. A text counts once for a language, however often it
    occurs. Texts are chosen by their hashes; only pieces of the chosen ones move, at most FIT_TEXTS of FIT_CHARS characters for each
    language."""
    known = docs.filter("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    chosen = first_rows(known.groupBy("lang", "h").agg(F.lit(1)), ["lang"], [F.asc("h")], FIT_TEXTS).select("lang", "h")
    begin = F.pmod("h", F.greatest(F.lit(1), F.char_length("text") - FIT_CHARS + 1)).cast("int") + 1
    pieces = known.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", F.substring("text", begin, FIT_CHARS).alias("text"))  # FIT_TEXTS rows a language
    spaced = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}]+", " ").alias("text")
    rows = pieces.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "h", spaced).orderBy("lang", "h").collect()
    parts: dict[str, list[str]] = {}
    for row in rows:
        if row["text"].strip():
            parts.setdefault(row["lang"], []).append(row["text"])
    return {lang: "".join(p[:max(1, FIT_ALL // len(own))] for p in own).encode() for lang, own in parts.items()}


def identified(docs: DataFrame, samples: Mapping[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The language of the whole text of every row of ``docs`` (doc_id, text, held_out) under given dictionaries: doc_id, held_out,
    lang_pred, score (the share by which the runner-up is larger than the answer; 1 where there is one language only) and rejected
    (the score is below ``margin``; the answer is still given). Of languages that are as small, the first by name is taken. A text
    that is null or has no letter is ``und``, with score 0 and rejected, and so is every text if there are no dictionaries."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(
        _classifier(samples, margin), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def languages(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``identified`` for every row of ``docs`` (doc_id, text, lang), with dictionaries learnt from the rows whose fold is not 2, which
    are the held-out ones. Equal rows stay as many as they are; extra columns are not looked at; no rows give none."""
    docs = docs.select("doc_id", "text", "lang", (fold() == 2).alias("held_out"))
    return identified(docs, fit(docs.filter("not held_out")), margin)
