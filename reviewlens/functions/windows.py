"""Windows of a text that may be one of many names, found by rolling hashes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from reviewlens.functions.arrow import in_bloom, mixed

#: Bytes of a name that are looked for first; shorter names are looked for whole.
PREFIX = 4
#: Base of the polynomial, odd so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15


class Rolling:
    """Hashes of any window of a run of bytes, each in constant time."""

    def __init__(self, data: np.ndarray):
        size = len(data)
        powers = np.cumprod(np.full(size + 1, BASE, np.uint64)) * np.uint64(pow(BASE, -1, 1 << 64))
        self.back = np.cumprod(np.full(size + 1, pow(BASE, -1, 1 << 64), np.uint64)) * np.uint64(BASE)
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:size], out=self.sums[1:])

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """The hashes of the windows of ``size`` bytes that begin at these places."""
        return mixed((self.sums[at + size] - self.sums[at]) * self.back[at] + np.uint64(size))


def name_keys(names: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the first bytes of each name, and of the whole."""
    sizes = np.array([len(n) for n in names], np.int64)
    starts = np.cumsum(sizes) - sizes
    rolling = Rolling(np.frombuffer(b"".join(names), np.uint8))
    heads, wholes = np.zeros(len(names), np.uint64), np.zeros(len(names), np.uint64)
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        wholes[mine] = rolling.windows(starts[mine], int(size))
        heads[mine] = rolling.windows(starts[mine], min(int(size), PREFIX))
    return heads, wholes


def find(data: np.ndarray, ends: np.ndarray, sizes: Sequence[int], heads: np.ndarray, wholes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the texts in ``data`` (text i up to ``ends[i]``) that may be names: text, place and bytes of each, every one
    once for each text. Two Bloom filters tell, of the first bytes of names and of whole names; ``sizes`` are those that names have."""
    rolling = Rolling(data)
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    left = ends[owner] - np.arange(len(data))
    # A window begins and ends where a character does.
    inside = (data & 0xC0) == 0x80
    whole = np.append(~inside, True)
    found = []
    for head in sorted({min(s, PREFIX) for s in sizes}):
        at = np.flatnonzero((left >= head) & whole[:-1])
        at = at[in_bloom(heads, rolling.windows(at, head))]
        for size in sizes:
            if min(size, PREFIX) != head:
                continue
            begin = at[left[at] >= size]
            begin = begin[whole[begin + size]]
            keys = rolling.windows(begin, size)
            hit = in_bloom(wholes, keys)
            begin, keys = begin[hit], keys[hit]
            _, first = np.unique(keys ^ mixed(owner[begin].astype(np.uint64) + np.uint64(1)), return_index=True)
            found.append((owner[begin[first]], begin[first], np.full(len(first), size)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(p) for p in zip(*found))
