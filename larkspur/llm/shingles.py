"""Rolling 64-bit hashes over the words of a text."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """word -> 64-bit hash, emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """The finalising permutation of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One mixed hash for each window of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = hashes[:n].copy()
    for j in range(1, width):
        h *= _MULTIPLIER
        h += hashes[j:n + j]
    return mix(h + np.uint64(width))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes (63 bits, so that they sort alike as
    signed numbers); a shorter text is one shingle, no words give the empty
    set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    return np.unique((windows(hashes, min(width, len(hashes))) >> np.uint64(1)).view(np.int64))
