"""Language-model scores from a weighted backoff automaton over n-grams of the corpus.

States are the histories that were seen; a state has an arc for each word that followed it, and a failure arc, with a weight, to
the state of the history without its first word. A text is walked from left to right with a state: at each token the failure arcs
are followed, and their weights paid, until a state has an arc for it, which leads to the next state; the log-probabilities add up.

The counts of a corpus fit no single task, so they never meet in one. Texts are cut into chunks; a chunk asks for the counts of its
own n-grams, by ranges of their hashes, and each range adds up what all chunks say and answers them. With the answers a chunk
builds the part of the automaton that its own texts can reach, and walks them: cut into lanes of some hundred tokens, all lanes
step by step side by side. A lane begins a few tokens early, which settles its state, as no state remembers more than those.

With h' for h without its first word, an arc of n-gram hw weighs (1 - g(h)) c(hw) / c(h) + g(h) p(w | h') and the failure arc of h
weighs g(h) = D c(h)^(b - 1). D is the discount of once- and twice-seen n-grams, n1 / (n1 + 2 n2); the exponent b makes the
distinct successors that the law expects, the sum of c(h)^b over all histories, equal to those that the corpus has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import fold, hashed, mixed, partitions, seeds, steps, words
from reviewlens.sources.storage import cut_lineage, fresh_folder

#: Words of the longest n-gram. With 3 the query needs more than the memory that the check tool gives an executor (see the README).
ORDER = 2
#: Tokens of a lane.
LANE = 512
#: Bytes of text in a chunk, and n-grams that a range takes on at most.
CHUNK_BYTES, RANGE_KEYS = 8 << 20, 4 << 20
#: Classes of counts by their power of two.
CLASSES = 64
END = 0x1F3D5B79A2C4E681
#: Low bits of the key of an n-gram of several words, which hold n alone: 48 bits of its hash are sent. Words keep theirs.
SHORT = 16


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for seq, batch in enumerate(steps(batches, most=CHUNK_BYTES)):
        counts, index, distinct = words(batch.column("text"))
        blob = [_counts(counts), _planes(index.astype("<u4")), hashed(distinct).tobytes()]
        ids, held = (batch.column(c) for c in ("doc_id", "held_out"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + seq]), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.concat_arrays([c])) for c in (ids, held)),
             *(pa.array([b], pa.binary()) for b in blob), pa.array([len(index) + len(counts)])],
            ["chunk", "doc_ids", "held", "counts", "index", "vocabulary", "tokens"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """One chunk at a time, however many a batch holds."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch, batch.slice(k, 1).to_pylist()[0]


def _counts(values: np.ndarray) -> bytes:
    """Counts, of which most are small."""
    return pa.compress(values.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _counted(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * size, codec="zstd", asbytes=True), "<i8")


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte of all, so that the upper bytes, which are mostly 0, take no room."""
    return pa.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, size: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, width * size, codec="zstd", asbytes=True), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _sent(keys: np.ndarray) -> list[bytes]:
    """Sorted keys by their differences, those of words and the others apart: the former in full, the latter without their low
    bits, but for n, which goes by itself."""
    words_ = (keys & np.uint64(7)) == 1
    rest = keys[~words_]
    return [np.int64(words_.sum()).tobytes(), _planes(np.diff(keys[words_], prepend=np.uint64(0)).astype("<u8")),
            _planes(np.diff(rest >> np.uint64(SHORT), prepend=np.uint64(0)).astype("<u8")), _planes((rest & np.uint64(7)).astype("<u1"))]


def _received(parts: list[bytes], size: int) -> np.ndarray:
    """The keys, words first."""
    n = int(np.frombuffer(parts[0], np.int64)[0])
    words_ = np.cumsum(_numbers(parts[1], n, "<u8"), dtype=np.uint64)
    rest = np.cumsum(_numbers(parts[2], size - n, "<u8"), dtype=np.uint64) << np.uint64(SHORT)
    return np.concatenate([words_, rest | _numbers(parts[3], size - n, "<u1").astype(np.uint64)])


def _laid(keys: np.ndarray) -> np.ndarray:
    """The order in which keys are sent."""
    return np.argsort((keys & np.uint64(7)) != 1, kind="stable")


class Texts:
    """The tokens of a chunk, each text closed by the end, and the keys of their n-grams."""

    def __init__(self, row: dict):
        counts = _counted(row["counts"], len(row["held"]))
        index = _numbers(row["index"], int(counts.sum()), "<u4")
        vocabulary = np.concatenate([np.frombuffer(row["vocabulary"], np.uint64), np.array([END], np.uint64)])
        self.lengths = counts + 1
        stops = np.cumsum(self.lengths)
        self.starts = stops - self.lengths
        inside = np.ones(stops[-1] if len(stops) else 0, bool)
        inside[stops - 1] = False
        self.end = len(vocabulary) - 1
        self.token = np.full(len(inside), self.end, np.int64)
        self.token[inside] = index
        self.coded = vocabulary[self.token]
        self.trained = np.repeat(~np.array(row["held"], bool), self.lengths)
        self.place = np.arange(len(self.token)) - np.repeat(self.starts, self.lengths)

    def keys(self, order: int) -> list[np.ndarray]:
        """For n = 1, 2, ...: the key of the n-gram that ends at each token, 0 where the text has not begun. The low bits are n."""
        weights, total, out = seeds(order, 4), np.zeros(len(self.coded), np.uint64), []
        for n in range(1, order + 1):
            total[n - 1:] += self.coded[:len(self.coded) - n + 1] * weights[n - 1]
            low = np.uint64(7 if n == 1 else (1 << SHORT) - 1)
            key = (mixed(total + np.array([n], np.uint64)) & ~low) | np.uint64(n)
            out.append(np.where(self.place >= n - 1, key, np.uint64(0)))
        return out

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """All distinct keys, sorted, and the place of each n-gram's among them; key 0 is the first if there is any."""
        return np.unique(np.concatenate(self.keys(order)), return_inverse=True)


def _asking(order: int, ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for _, row in _rows(batches):
            texts = Texts(row)
            keys, at = texts.distinct(order)
            seen = np.bincount(at, np.tile(texts.trained, order), len(keys))
            if len(keys) and keys[0] == 0:
                keys, seen = keys[1:], seen[1:]
            bounds = np.searchsorted(_range(keys, ranges), np.arange(ranges + 1))
            for k in np.flatnonzero(np.diff(bounds)):
                own, count = keys[bounds[k]:bounds[k + 1]], seen[bounds[k]:bounds[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(k)], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([len(own)], pa.int32()),
                     pa.array([_sent(own)], pa.list_(pa.binary())), pa.array([_counts(count[_laid(own)])], pa.binary())], ["range", "chunk", "n", "keys", "seen"])
    return run


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _answer(order: int) -> Callable[[pa.Table], pa.Table]:
    """Counts of all chunks added up, handed back to each in the order it asked; and, with one of the answers, what the range adds
    to the statistics: for each n the n-grams by class of count, their tokens by class, and those seen once and twice."""
    def run(rows: pa.Table) -> pa.Table:
        keys = [_received(k, n) for k, n in zip(rows.column("keys").to_pylist(), rows.column("n").to_pylist())]
        seen = np.concatenate([_counted(s.as_buffer(), len(k)) for s, k in zip(rows.column("seen"), keys)])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, seen, len(distinct)).astype(np.int64)
        figures = []
        for n in range(1, order + 1):
            own = total[((distinct & np.uint64(7)) == n) & (total > 0)]
            kind = np.frexp(own.astype(float))[1] - 1
            figures += [*np.bincount(kind, minlength=CLASSES).tolist(), *np.bincount(kind, own, CLASSES).astype(np.int64).tolist(),
                        int((own == 1).sum()), int((own == 2).sum())]
        bounds = np.cumsum([0, *map(len, keys)])
        answers = [_counts(total[at[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.table([rows.column("chunk"), rows.column("range"), pa.array(answers, pa.binary()),
                         pa.array([figures] + [None] * (len(rows) - 1), pa.list_(pa.int64()))], ["chunk", "range", "totals", "figures"])
    return run


class Law:
    """What the corpus says about n-grams as such: tokens and types of words, and for each n the discount and the exponent."""

    def __init__(self, figures: np.ndarray):
        parts = figures.reshape(-1, 2 * CLASSES + 2)
        self.types, self.tokens = int(parts[0, :CLASSES].sum()), int(parts[0, CLASSES:2 * CLASSES].sum())
        self.discount, self.exponent = [1.0], [1.0]
        for lower, own in zip(parts[:-1], parts[1:]):
            histories, mass, successors = lower[:CLASSES], lower[CLASSES:2 * CLASSES], own[:CLASSES].sum()
            mean, used = mass / np.maximum(1, histories), histories > 0
            low, high = 0.0, 1.0
            for _ in range(50):
                middle = (low + high) / 2
                low, high = (middle, high) if (histories[used] * mean[used] ** middle).sum() < successors else (low, middle)
            once, twice = own[-2:]
            self.discount.append(float(once / (once + 2 * twice)) if once else 0.5)
            self.exponent.append(high)

    def word(self, count: np.ndarray) -> np.ndarray:
        """The probability of a word by itself; the unseen ones share that of half a token."""
        return (count + 0.5) / (self.tokens + 0.5 * (self.types + 1))

    def failure(self, n: int, history: np.ndarray) -> np.ndarray:
        """The weight of the failure arc of histories of n - 1 words, by their counts; 1 for those that are no states."""
        return np.where(history > 0, np.minimum(1.0, self.discount[n - 1] * np.maximum(history, 1).astype(float) ** (self.exponent[n - 1] - 1)), 1.0)


class Automaton:
    """The states, arcs and failure arcs that the texts of a chunk can reach. State 0 is the empty history."""

    def __init__(self, texts: Texts, at: list[np.ndarray], total: np.ndarray, law: Law):
        """``at[n - 1]`` is the place, among all keys, of the n-gram that ends at each token, and ``total`` has their counts."""
        order, self.width = len(at), texts.end + 1
        n_states, arcs = 1, []
        #: By place among the keys: the state that an n-gram as a history leads to, and the probability of its last word after the others.
        state, chance = np.zeros(len(total), np.int64), np.zeros(len(total))
        self.fail, self.paid = [np.zeros(1, np.int64)], [np.zeros(1)]
        for n in range(1, order + 1):
            ends = np.flatnonzero(texts.place >= n - 1)
            grams, first = np.unique(at[n - 1][ends], return_index=True)
            last = ends[first]  # a token at which each of the n-grams ends
            word, count = texts.token[last], total[grams]
            suffix = at[n - 2][last] if n > 1 else None
            before = at[n - 2][last - 1] if n > 1 else None
            if n == 1:
                chance[grams], source, seen = law.word(count), np.zeros(len(grams), np.int64), np.ones(len(grams), bool)
            else:
                history = total[before]
                fail = law.failure(n, history)
                chance[grams] = (1 - fail) * count / np.maximum(history, 1) + fail * chance[suffix]
                source, seen = state[before], count > 0
            # The histories of the next n-grams are states where they were seen; others stand for their suffix.
            known = (count > 0) & (word != texts.end) & (n < order)
            state[grams] = np.where(known, n_states + np.cumsum(known) - 1, state[suffix] if n > 1 else 0)
            arcs.append((source[seen] * self.width + word[seen], state[grams[seen]], np.log10(chance[grams[seen]])))
            self.fail.append((state[suffix] if n > 1 else np.zeros(len(grams), np.int64))[known])
            self.paid.append(np.log10(law.failure(n + 1, count[known])) if n < order else np.zeros(0))
            n_states += int(known.sum())
        self.fail, self.paid = np.concatenate(self.fail), np.concatenate(self.paid)
        keys, target, weight = (np.concatenate(p) for p in zip(*arcs))
        laid = np.argsort(keys, kind="stable")
        self.keys, self.target, self.weight = keys[laid], target[laid], weight[laid]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and what the arcs to them cost."""
        state, cost, left = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(left):
            key = state[left] * self.width + word[left]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            cost[left[hit]] += self.weight[arc[hit]]
            state[left[hit]] = self.target[arc[hit]]
            left = left[~hit]
            cost[left] += self.paid[state[left]]
            state[left] = self.fail[state[left]]
        return state, cost

    def walk(self, texts: Texts, order: int) -> np.ndarray:
        """The log-probability of each text."""
        lanes = -(-texts.lengths // LANE)
        text = np.repeat(np.arange(len(lanes)), lanes)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        stop = np.minimum(begin + LANE, texts.lengths[text])
        early = np.minimum(begin, order - 1)
        order_ = np.argsort(-(stop - begin + early), kind="stable")
        text, begin, stop, early = text[order_], begin[order_], stop[order_], early[order_]
        steps_, at = stop - begin + early, texts.starts[text] + begin - early
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        for k in range(int(steps_.max(initial=0))):
            on = int(np.searchsorted(-steps_, -k, side="left"))  # lanes of more than k steps come first
            state[:on], cost = self.step(state[:on], texts.token[at[:on] + k])
            total[:on] += np.where(k >= early[:on], cost, 0.0)
        return np.bincount(text, total, len(lanes))


def _walk(order: int, law: Law) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch, row in _rows(batches):
            texts = Texts(row)
            keys, at = texts.distinct(order)
            ranges = _range(keys, row["ranges"])
            total = np.zeros(len(keys), np.int64)
            for answer in row["answers"]:
                begin, stop = np.searchsorted(ranges, [answer["range"], answer["range"] + 1])
                begin += int(begin == 0 and keys[0] == 0)  # the key of no n-gram was not asked for
                total[begin + _laid(keys[begin:stop])] = _counted(answer["totals"], stop - begin)
            at = at.reshape(order, -1)
            one = total[at[0]]
            score = Automaton(texts, list(at), total, law).walk(texts, order)
            known, base = (np.add.reduceat(v, texts.starts) for v in (one > 0, np.log10(law.word(one))))
            size = len(texts.lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(row["held"]), pa.array(texts.lengths),
                 pa.array(known.astype(np.int64)), pa.array(np.full(size, law.tokens)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def scored(docs: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text) with a model of the rows for which the column ``held_out`` is false.

    Returns doc_id, held_out, n_tokens (words and the end), n_known (seen in training), train_tokens, base_score (words by themselves,
    log10) and score (the automaton, log10). A null text is empty and has the end alone. Rows count as often as they occur. ``order`` is
    at most 7.

    A chunk holds CHUNK_BYTES of text or one text; ranges are as many as the tokens ask for. Counts are combined inside a chunk
    before they move, and n-grams are dealt by hash, so a frequent word makes no task larger than others. Chunks are stored by
    buckets of their number, so that answers come to them and they do not move.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    folder = fresh_folder(spark, "chunks")
    name = folder.rsplit("/", 1)[1].replace("-", "_")
    (docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(
        _chunks, f"chunk long, doc_ids array<{kind}>, held array<boolean>, counts binary, index binary, vocabulary binary, tokens long")
     .write.bucketBy(partitions(spark), "chunk").option("path", folder).option("compression", "uncompressed").saveAsTable(name))
    chunks = spark.table(name)
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    ranges = max(partitions(spark), -(-tokens * order // RANGE_KEYS))
    asked = chunks.mapInArrow(_asking(order, ranges), "range int, chunk long, n int, keys array<binary>, seen binary")
    answers = cut_lineage(asked.groupBy("range").applyInArrow(_answer(order), "chunk long, range int, totals binary, figures array<long>"))
    figures = answers.filter("figures is not null").select(F.posexplode("figures")).groupBy("pos").agg(F.sum("col")).orderBy("pos").collect()
    law = Law(np.array([r[1] for r in figures], np.int64) if figures else np.zeros(order * (2 * CLASSES + 2), np.int64))
    gathered = answers.groupBy("chunk").agg(F.collect_list(F.struct("range", "totals")).alias("answers"))
    return chunks.join(gathered, "chunk").withColumn("ranges", F.lit(ranges)).mapInArrow(
        _walk(order, law), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_model_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``scored`` with every fifth document (fold 1) held out."""
    return scored(docs, fold() == 1, order)
