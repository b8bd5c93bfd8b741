"""Vectorised words, shingles and hashes of Arrow text batches.

All hashes are 64-bit rolling sums over a fixed table of random byte values, finished by a bit mixer, so
they depend on content alone and agree between tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

STEP = 1 << 20
_random = np.random.default_rng(20240229)
BYTE_VALUES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


@lru_cache
def kept_powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of both bases for usual lengths; made in tasks, so that the driver does not hold them."""
    return powers(MULTIPLIER, STEP + (1 << 16)), powers(INVERSE, STEP + (1 << 16))


def rolling(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers: the hash of ``[s, e)`` is ``(prefix[e] - prefix[s]) * inverses[s]``."""
    n = len(values)
    p, q = kept_powers() if n < STEP + (1 << 16) else (powers(MULTIPLIER, n + 1), powers(INVERSE, n + 1))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * p[:n], out=prefix[1:])
    return prefix, q[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, limit: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes together; a longer row comes alone."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, at: np.ndarray, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in ``data``; ``at`` are the row offsets, which also part words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at[(at >= 0) & (at <= len(data))]] = True
    before = np.concatenate(([False], word[:-1])) & ~cut[:-1]
    after = np.concatenate((word[1:], [False])) & ~cut[1:]
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def hashed_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``, in bounded steps for long data."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + STEP, "right")))
        low, high = int(starts[first]), int(ends[last - 1])
        prefix, inverse = rolling(BYTE_VALUES[data[low:high]])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mixed((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(np.uint64))
        first = last
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out = out * MULTIPLIER + words[j : len(words) - n + 1 + j]
    return mixed(out)


def rows_of_words(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row: its number, word hashes, and the starts and ends of its words in its own bytes, and those bytes."""
    data, at = column_bytes(column)
    for first, last in slices(at):
        base = int(at[first])
        part = data[base : int(at[last])]
        if lower:
            part = LOWER[part]
        own = at[first : last + 1] - base
        starts, ends = word_spans(part, own)
        hashes = hashed_spans(part, starts, ends)
        cuts = np.searchsorted(starts, own)
        for i in range(last - first):
            a, b = cuts[i], cuts[i + 1]
            yield first + i, hashes[a:b], starts[a:b] - own[i], ends[a:b] - own[i], part[own[i] : own[i + 1]]


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes as signed integers; fewer than ``n`` words are one shingle, none gives none."""
    if not len(words):
        return np.zeros(0, np.int64)
    if len(words) < n:
        return grams(words, len(words)).view(np.int64)
    return np.unique(grams(words, n).view(np.int64))
