"""Words and word shingles of whole texts, as numpy arrays, for Arrow-batched functions.

A word is a run of bytes other than space and U+0009 to U+000D. Words are looked
up in a bounded per-worker table; it is emptied when full, so results never
depend on what a worker saw before.
"""

from __future__ import annotations

import numpy as np
import xxhash

from lexigrid.llm._shared import LOWER

#: Words a worker remembers.
REMEMBERED = 100_000

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; a shorter text is one shingle, no word none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    mixed = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        mixed += ids[k : n - size + 1 + k] * np.uint64(_ODD[k % 5])
        mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)
