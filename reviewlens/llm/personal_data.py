"""Personal data in texts: exact patterns, and a character tagger that adds what they do not write down.

The tagger is learnt from spans of the patterns in a bounded sample of documents, also in looser spellings, and reads every text in
overlapping windows. A character's tag is taken from the window in which it stands nearest to the middle, so the windows of a text
come to one labelling; its spans are checked, and those that touch no span of the patterns are added. All kinds have a digit or an
at sign, so a window without either is outside throughout and is not worked out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import steps
from reviewlens.llm.tagger import Tagger, classes

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from one window to the next.
WINDOW, STRIDE = 64, 32
#: The sample: documents of at most so many bytes in which one of the patterns begins to match, in the order of a hash of their ids;
#: windows with spans, and windows without; rounds.
FIT_DOCUMENTS, FIT_BYTES, FIT_WINDOWS, FIT_PLAIN, ROUNDS = 2000, 8192, 2500, 1500, 5
#: What a text has that holds a span of a pattern.
_BEGUN = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){13}|\+[0-9][ ().0-9-]{8}"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_IP = r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
_CARD = r"[0-9]([\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What a span of the tagger must look like.
_LOOSE = {
    "email": r"[A-Za-z0-9._%+-]+\x20?@\x20?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "phone": r"(\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}",
    "card": _CARD,
    "ip": r"[0-9]{1,3}(\.[0-9]{1,3}){3}",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in text.split(".")))
    if kind == "card":
        return 14 <= len(_digits(text)) <= 19 and luhn(_digits(text))
    if kind == "phone":
        return 10 <= len(_digits(text)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at signs so that long runs of letters are walked once."""
    end, at, domain = 0, text.find("@"), re.compile(_DOMAIN)
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = domain.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Matches of the patterns as (start, rank of the kind, end), sorted; those of one kind do not overlap."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if re.search(r"[0-9]", text):
        for rank, (kind, pattern) in enumerate((("ip", _IP), ("card", _CARD), ("phone", _PHONE)), 1):
            found += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text) if valid(kind, m[0])]
    return sorted(found)


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text, and the starts of the windows that hold a digit or an at sign."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
    steps_ = signs // STRIDE
    return codes, np.unique(np.concatenate([steps_, np.maximum(steps_ - 1, 0)])) * STRIDE


def symbols_at(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbols of windows, filled up with 0 behind the end of the text."""
    padded = np.concatenate([classes(codes), np.zeros(WINDOW, np.int64)])
    return padded[starts[:, None] + np.arange(WINDOW)]


def reconciled(length: int, starts: np.ndarray, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """The spans of a text from the tags of its windows: each character is read from the window whose middle is nearest."""
    whole = np.zeros(length + WINDOW, np.int8)
    edge = (WINDOW - STRIDE) // 2
    known = set(starts.tolist())
    for start, row in zip(starts.tolist(), tags):
        begin = 0 if start - STRIDE not in known else edge
        stop = WINDOW if start + STRIDE not in known else WINDOW - edge
        whole[start + begin:start + stop] = row[begin:stop]
    spans, k = [], 0
    marked = np.flatnonzero(whole[:length])
    while k < len(marked):
        start = int(marked[k])
        kind, stop = (whole[start] - 1) // 2, start + 1
        while stop < length and whole[stop] == 2 * kind + 2:
            stop += 1
        spans.append((start, int(kind), stop))
        k = int(np.searchsorted(marked, stop))
    return spans


def _looser(rank: int, text: str, chance: float) -> str:
    """Another spelling of a span, for some of the windows."""
    if rank == 0 and chance < 0.3:
        return text.replace("@", " @ ")
    if rank == 3 and chance < 0.5:
        return re.sub(r"^\+[0-9]+[\x20.-]?", "", text)
    return text


def fit(texts: list[str], seed: int = 3) -> Tagger | None:
    """A tagger from the spans of these texts; none where there are no spans."""
    rng = np.random.default_rng(seed)
    rows, marks = [], []
    for text in texts:
        shift, parts, spans, last = 0, [], [], 0
        for start, rank, end in base_spans(text):
            if start < last:
                continue
            other = _looser(rank, text[start:end], rng.random())
            parts += [text[last:start], other]
            spans.append((start + shift, rank, start + shift + len(other)))
            shift, last = shift + len(other) - (end - start), end
        text = "".join([*parts, text[last:]])
        codes, starts = windows_of(text)
        tags = np.zeros(len(codes) + WINDOW, np.int64)
        for start, rank, end in spans:
            tags[start], tags[start + 1:end] = 2 * rank + 1, 2 * rank + 2
        rows.append(symbols_at(codes, starts))
        cut = tags[starts[:, None] + np.arange(WINDOW)]
        first = cut[:, 0]
        cut[:, 0] = np.where((first > 0) & (first % 2 == 0), first - 1, first)  # a window may begin inside a span
        marks.append(cut)
    if not rows or not any(m.any() for m in marks):
        return None
    symbols, tags = np.concatenate(rows), np.concatenate(marks)
    marked = tags.any(1)
    chosen = rng.permutation(np.concatenate([rng.permutation(np.flatnonzero(marked == on))[:most] for on, most in ((True, FIT_WINDOWS), (False, FIT_PLAIN))]))
    tagger = Tagger(len(KINDS))
    tagger.train(symbols[chosen], tags[chosen], ROUNDS)
    return tagger


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[rank]}:{start}:{end}" for start, rank, end in sorted(spans))


def _finder(tagger: Tagger | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    loose = {kind: re.compile(pattern) for kind, pattern in _LOOSE.items()}

    def added(text: str, base: list, tagged: list) -> list:
        out = []
        for start, rank, end in tagged:
            kind = KINDS[rank]
            if loose[kind].fullmatch(text, start, end) and valid(kind, text[start:end]) and all(e <= start or s >= end for s, _, e in base):
                out.append((start, rank, end))
        return out

    def run(batches):
        import hashlib
        for batch in steps(batches):
            texts = pc.fill_null(batch.column("text"), "")
            at = np.flatnonzero(pc.match_substring_regex(texts, "[0-9@]").to_numpy(zero_copy_only=False))
            found, more = {}, {}
            cut = [(int(i), text, *windows_of(text)) for i, text in zip(at, texts.take(pa.array(at)).to_pylist())]
            for i, text, codes, starts in cut:
                found[i] = base_spans(text)
            if tagger and cut:
                symbols = np.concatenate([symbols_at(codes, starts) for _, _, codes, starts in cut])
                tags = np.concatenate([tagger.decode(symbols[k:k + 512]) for k in range(0, len(symbols), 512)])
                begin = 0
                for i, text, codes, starts in cut:
                    more[i] = added(text, found[i], reconciled(len(codes), starts, tags[begin:begin + len(starts)]))
                    begin += len(starts)
            base = [found.get(i, []) for i in range(batch.num_rows)]
            counts = np.zeros((batch.num_rows, len(KINDS)), np.int64)
            for i, spans in found.items():
                for _, rank, _ in spans:
                    counts[i, rank] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(KINDS))),
                 pa.array([hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base]),
                 pa.array([_joined(spans + more.get(i, [])) for i, spans in enumerate(base)]),
                 pa.array([len(more.get(i, [])) for i in range(batch.num_rows)], pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """Find personal data in every whole text of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (spans of the patterns),
    base_sha256 (of those as kind:start:end, by start and then kind, comma-joined; code points), spans (all, alike) and n_added.
    A null or empty text has none. Equal rows each have a row. The tagger learns from at most FIT_DOCUMENTS documents in which a pattern
    begins to match, however rare these are; where there are none, it adds nothing."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    short = docs.select("doc_id", "text").filter((F.octet_length("text") <= FIT_BYTES) & F.col("text").rlike(_BEGUN))
    # Ids are ranked without their texts, so that what tasks send for it stays small; then at most FIT_DOCUMENTS texts are.
    chosen = F.broadcast(short.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS))
    sample = short.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id")
    tagger = fit([row[0] for row in sample.select("text").collect()])
    return docs.select("doc_id", "text").mapInArrow(
        _finder(tagger), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
