"""Token-set similarity of names, the small per-pair helper behind fuzzy matching."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step per letter of ``b``."""
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for letter in b:
        hit = state & places.get(letter, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _ratio(distance: int, total: int) -> float:
    return 100.0 - 100.0 * distance / total if total else 100.0


class Name:
    """A name as its set of words."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.words = frozenset(text.split())
        self.sorted = " ".join(sorted(self.words))


def token_set_ratio(a: Name, b: Name, at_least: float = 0.0) -> float:
    """0..100; 100 when the words of one name all occur in the other.

    The common words are compared with either full name, and the full names with each other, by
    inserted and deleted letters over total length. A result below ``at_least`` may come back as a
    smaller number: the letters are not compared when lengths alone rule it out.
    """
    if not a.words or not b.words:
        return 0.0
    common = a.words & b.words
    head = gap = 0
    tail_a, tail_b = a.sorted, b.sorted
    if common:
        rest_a, rest_b = a.words - common, b.words - common
        if not (rest_a and rest_b):
            return 100.0
        tail_a, tail_b = " ".join(sorted(rest_a)), " ".join(sorted(rest_b))
        head, gap = len(" ".join(sorted(common))), 1
    long_a, long_b = head + gap + len(tail_a), head + gap + len(tail_b)
    best = 0.0
    if common:
        best = max(_ratio(gap + len(tail_a), head + long_a), _ratio(gap + len(tail_b), head + long_b))
    if _ratio(abs(len(tail_a) - len(tail_b)), long_a + long_b) >= max(best, at_least):
        distance = len(tail_a) + len(tail_b) - 2 * common_subsequence(tail_a, tail_b)
        best = max(best, _ratio(distance, long_a + long_b))
    return best


class Letters:
    """Names to be compared with mentions letter by letter, many at once."""

    #: Kinds of letters that are counted, and words of a name, by hash, in one number of so many bits.
    KINDS, BITS = 32, 64

    def __init__(self, names: Sequence[str]) -> None:
        self.names = [Name(n) for n in names]
        self.sizes = np.array([len(n.sorted) for n in self.names], np.int64)
        alphabet = sorted({c for n in self.names for c in n.sorted})
        self.code = {c: i + 1 for i, c in enumerate(alphabet)}  # 0 is the place after the end
        self.codes = np.zeros((max(self.sizes, default=0), len(self.names)), np.int32)
        for i, n in enumerate(self.names):
            self.codes[:self.sizes[i], i] = [self.code[c] for c in n.sorted]
        self.counts = np.stack([self._counts(n) for n in self.names]) if self.names else np.zeros((0, self.KINDS), np.int32)
        self.words = np.array([self._mask(n) for n in self.names], np.uint64)

    def _counts(self, name: Name) -> np.ndarray:
        return np.bincount([ord(c) % self.KINDS for c in name.sorted], minlength=self.KINDS).astype(np.int32)

    def _mask(self, name: Name) -> np.uint64:
        out = 0
        for w in name.words:
            out |= 1 << zlib.crc32(w.encode("utf-8", "replace")) % self.BITS
        return np.uint64(out)

    def alike(self, mention: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(place, score) of the names that may score at least ``least``, all that do among them. Names that differ in more
        letters than the score allows are left out by their counts; those that share no word are scored together, one step of
        the common subsequence for a letter of each; the others one by one."""
        asked = Name(mention)
        if not asked.words:
            return np.zeros(0, np.int64), np.zeros(0)
        total = self.sizes + len(asked.sorted)
        at = np.flatnonzero(np.abs(self.counts - self._counts(asked)).sum(1) <= (1 - least / 100) * total + 1e-9)
        shared = (self.words[at] & self._mask(asked)) != 0
        if len(asked.sorted) > 64:
            shared[:] = True
        score = np.zeros(len(at))
        apart = at[~shared]
        if len(apart):
            place = np.zeros(len(self.code) + 1, np.uint64)
            for i, c in enumerate(asked.sorted):
                if c in self.code:
                    place[self.code[c]] |= np.uint64(1 << i)
            full = np.uint64((1 << len(asked.sorted)) - 1)
            state = np.full(len(apart), full, np.uint64)
            for row in self.codes[:self.sizes[apart].max(), apart]:
                hit = state & place[row]
                state = ((state + hit) | (state - hit)) & full
            common = len(asked.sorted) - np.bitwise_count(state).astype(np.int64)
            score[~shared] = 100.0 - 100.0 * (total[apart] - 2 * common) / total[apart]
        score[shared] = [token_set_ratio(asked, self.names[i], least) for i in at[shared]]
        return at, score
