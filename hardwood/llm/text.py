"""Helpers for work on whole texts inside tasks: bounded slices of a batch, word hashes, windows of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once by a Python worker; one longer text is a slice of its own.
SLICE_BYTES = 1_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    """(low, high, texts) of neighbouring rows of at most `limit` bytes together (one row at least); only one slice is held as strings."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
    low = 0
    while low < len(column):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield low, high, column.slice(low, high - low).to_pylist()
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word (bytes) -> signed 64-bit hash, remembered for at most `limit` words; the value never depends on the memory."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        if len(self) < self.limit:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, with A-Z lower-cased on request."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def windows(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay inside one document, and the index of each window's first word."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    size = len(hashes) - n + 1
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + size]
    first = np.flatnonzero(doc[:size] == doc[n - 1 :])
    return mix(h[first]), first
