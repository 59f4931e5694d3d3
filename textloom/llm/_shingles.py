"""64-bit word and shingle hashes, vectorised with numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from ._shared import WORKER_CACHES

WORD_ENTRIES = 150_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = _Words()
WORKER_CACHES["words"] = _words


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_words) > WORD_ENTRIES:
        _words.clear()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash per place of a window of k words (needs len(hashes) >= k)."""
    n = len(hashes) - k + 1
    out = mix(hashes[:n] + np.uint64(k))
    for i in range(1, k):
        out = mix(out * _STEP + hashes[i : n + i])
    return out


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct shingles; fewer than k words are one shingle as a whole; none is empty."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(shingle_hashes(h, min(k, len(words))))


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
