"""Toxicity by subword bags: vectors of hashed character n-grams are averaged into words, words into documents, and a softmax
over two classes reads the document; all are trained together in numpy.

Misspelt words share most of their n-grams with the word they stand for, so they are scored without having been seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.arrow import give_back
from reviewlens.llm.common import GOLDEN, fold, mixed, steps, words

BUCKETS = 1 << 19
SHORTEST, LONGEST = 3, 5
DIMENSIONS = 4
ROUNDS = 60
#: The model is fitted on at most so many labelled documents of each class, in the order of a hash of their ids, of at most so many
#: bytes each; the class shares of all labelled rows are put back as weights.
FIT_ROWS, FIT_BYTES = 2500, 8192
#: Averages are multiplied by this before the softmax, so that a few telling words among hundreds need no huge vectors.
GAIN = 50.0
#: Weight of half the squared vectors beside the mean loss: an n-gram goes as far from zero as the fitted rows bear it out, so
#: that rare ones stay near it unless they are telling.
SHRINK = 1e-5
#: Words whose n-grams are held at a time.
WORDS_AT_ONCE = 1 << 14
#: Fitted texts that are split at a time.
TEXTS_AT_ONCE = 256
#: Step of the fit.
RATE = 0.1


def word_grams(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams (bytes, the word between two marks) and of the word itself, and how many each word has."""
    parts = distinct.cast(pa.large_binary()).to_pylist()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 2
    data = np.frombuffer(b"<" + b"><".join(parts) + b">", np.uint8).astype(np.uint64) if parts else np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    owner, left = np.repeat(np.arange(len(parts)), sizes), np.repeat(ends, sizes) - np.arange(len(data))
    rolling, found, of = data + np.uint64(1), [], []
    for n in range(2, LONGEST + 1):
        rolling = rolling[:-1] * np.uint64(0x100000001B3) + data[n - 1:] + np.uint64(1)
        if n >= SHORTEST:
            at = np.flatnonzero(left[:len(rolling)] >= n)
            found.append(mixed(rolling[at] + mixed(np.array([n], np.uint64))))
            of.append(owner[at])
    # The whole word: its bytes weighed by place.
    place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    weighed = mixed(data + mixed(place.astype(np.uint64) + GOLDEN))
    found.append(mixed(np.add.reduceat(weighed, ends - sizes)) if len(parts) else np.zeros(0, np.uint64))
    of.append(np.arange(len(parts)))
    bucket, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (bucket[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(of, minlength=len(parts))


def grams_of(distinct: pa.Array, step: int = WORDS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """``word_grams``, some words at a time."""
    parts = [word_grams(distinct[k:k + step]) for k in range(0, max(1, len(distinct)), step)]
    return np.concatenate([g.astype(np.int32) for g, _ in parts]), np.concatenate([n for _, n in parts])


def pairs_of(texts: pa.Array, step: int = TEXTS_AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The distinct words of each text, some texts at a time: text, word (an index into all distinct words), the share of the
    text's words that it makes up, and the distinct words."""
    known, docs, found, shares = [], [], [], []
    for begin in range(0, len(texts), step):
        counts, index, distinct = words(texts[begin:begin + step])
        width = max(1, len(distinct))
        pair, n_pair = np.unique(np.repeat(np.arange(len(counts)), counts) * width + index, return_counts=True)
        doc = pair // width
        docs.append((begin + doc).astype(np.int32))
        found.append((pair % width).astype(np.int32))
        shares.append((n_pair / counts[doc]).astype(np.float32))
        known.append(distinct)
    coded = pa.chunked_array(known, pa.large_string()).combine_chunks().dictionary_encode()
    place, before = coded.indices.to_numpy(), np.cumsum([0, *map(len, known)])
    found = [place[b:][f] for b, f in zip(before, found)]
    return *(np.concatenate([np.zeros(0, kind), *parts]) for kind, parts in ((np.int32, docs), (np.int32, found), (np.float32, shares))), coded.dictionary


def train(texts: pa.Array, labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit by Adam on all rows at once. The model is linear in the averages, so it is returned as one number per bucket (its vector
    times the difference of the classes) and a bias. N-grams are kept as one index each; sums over them go by slices of words."""
    pair_doc, pair_word, share, distinct = pairs_of(texts)
    share *= np.float32(GAIN)
    grams, n_grams = grams_of(distinct)
    n_words = len(n_grams)
    # Buckets that no word has stay out of the arithmetic.
    used = np.flatnonzero(np.bincount(grams, minlength=BUCKETS))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    grams = place[grams]
    bounds = np.concatenate([[0], np.cumsum(n_grams)])
    slices = [(k, min(k + WORDS_AT_ONCE, n_words)) for k in range(0, n_words, WORDS_AT_ONCE)]
    size = np.maximum(n_grams, 1)
    rng = np.random.default_rng(seed)
    state = [rng.normal(0, 0.1, (DIMENSIONS, len(used))).astype(np.float32), rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in state]
    target = np.eye(2)[labels]
    scale = weights / weights.sum()

    def read(vector: np.ndarray) -> np.ndarray:
        """Averages of documents. Every word has an n-gram, itself."""
        word = np.zeros(n_words)
        for a, b in slices:
            word[a:b] = np.add.reduceat(vector[grams[bounds[a]:bounds[b]]].astype(float), bounds[a:b] - bounds[a])
        return np.bincount(pair_doc, (word / size)[pair_word] * share, len(texts))

    def spread(slope: np.ndarray) -> np.ndarray:
        """The slopes of buckets from those of documents."""
        word = np.bincount(pair_word, slope[pair_doc] * share, n_words) / size
        out = np.zeros(len(used))
        for a, b in slices:
            out += np.bincount(grams[bounds[a]:bounds[b]], np.repeat(word[a:b], n_grams[a:b]), len(used))
        return out.astype(np.float32)

    for step in range(1, ROUNDS + 1):
        vectors, softmax, bias = state
        doc = np.stack([read(vector) for vector in vectors], 1)
        logits = doc @ softmax + bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        error = (odds / odds.sum(1, keepdims=True) - target) * scale[:, None]
        slopes = [np.stack([spread(slope) for slope in (error @ softmax.T).T]) + np.float32(SHRINK) * vectors, doc.T @ error, error.sum(0)]
        for parameter, slope, (m, v) in zip(state, slopes, moments):
            for row in range(len(parameter)):  # a dimension at a time
                m[row] += 0.1 * (slope[row] - m[row])
                v[row] += 0.01 * (slope[row] * slope[row] - v[row])
                parameter[row] -= RATE * (m[row] / (1 - 0.9 ** step)) / (np.sqrt(v[row] / (1 - 0.99 ** step)) + 1e-9)
    vectors, softmax, bias = state
    out = np.zeros(BUCKETS)
    out[used] = GAIN * ((softmax[:, 1] - softmax[:, 0]) @ vectors)
    return out, float(bias[1] - bias[0])


def scores(texts: pa.Array, model: np.ndarray, bias: float) -> np.ndarray:
    """The chance that each text is toxic."""
    counts, index, distinct = words(texts)
    parts = [np.zeros(0)]
    for k in range(0, len(distinct), WORDS_AT_ONCE):
        grams, n_grams = word_grams(distinct[k:k + WORDS_AT_ONCE])
        parts.append(np.bincount(np.repeat(np.arange(len(n_grams)), n_grams), model[grams], len(n_grams)) / np.maximum(n_grams, 1))
    per_word = np.concatenate(parts)
    owner = np.repeat(np.arange(len(counts)), counts)
    logit = np.bincount(owner, per_word[index], len(counts)) / np.maximum(counts, 1) + bias
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def _scorer(model: np.ndarray, bias: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in steps(batches):
            score = scores(batch.column("text"), model, bias)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
    return run


def _keeper(model: np.ndarray, bias: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in steps(batches):
            yield batch.filter(pa.array(scores(batch.column("text"), model, bias) < 0.5))
    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model from rows of ``docs`` that have a label toxic of 0 or 1 and a fold other than 0, within FIT_ROWS and FIT_BYTES. A
    doc_id with several labels counts as toxic if one says so; of its rows one is used. Without rows of both classes nothing can be
    learnt: the model is zeros and every score is 0.5."""
    marked = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold() != 0)
    shares = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= FIT_BYTES)
    known = short.select("doc_id").distinct().join(marked, "doc_id")
    parts = [known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS) for label in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most 2 x FIT_ROWS rows
    rows = (short.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").toArrow())
    target = rows.column("toxic").to_numpy().astype(np.int64)
    if len(np.unique(target)) < 2:
        return np.zeros(BUCKETS), 0.0
    weights = np.array([shares.get(k, 0) for k in (0, 1)]) / np.maximum(1, np.bincount(target, minlength=2))
    model = train(rows.column("text").combine_chunks(), target, weights[target])
    give_back()
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score the whole text of every row of ``docs`` (doc_id, text) with a model fitted on ``labels`` (doc_id, toxic).

    Returns doc_id, held_out (the fold is 0, so the row was not learnt from), score (0 to 1) and predicted (1 from 0.5 on). A null or
    empty text gets the score of the bias. Only texts are read for a score. The model is one number for each of BUCKETS buckets.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", (fold() == 0).alias("held_out")).mapInArrow(
        _scorer(*fit(docs, labels)), f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that score below one half; no row moves. All rows where nothing could be learnt."""
    model, bias = fit(docs, labels)
    return docs.mapInArrow(_keeper(model, bias), docs.schema) if model.any() else docs
