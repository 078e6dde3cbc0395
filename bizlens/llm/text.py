"""Vectorised views of text columns: words, word hashes and shingles over Arrow batches.

A batch of texts is one byte buffer plus offsets, so word boundaries and hashes are
numpy operations over whole slices of a batch. A slice holds at most ``SLICE_BYTES``
of text (or one longer text), which bounds the temporary arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

#: Word separators (fixed values): space and the ASCII controls tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: Every ASCII byte but letters and digits separates plain words.
NOT_PLAIN = np.ones(256, bool)
NOT_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    """Powers of the hash base, grown to the longest word seen by this worker."""

    def __init__(self) -> None:
        self.values = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            grown = np.full(max(n, 2 * len(self.values)), _BASE, np.uint64)
            grown[0] = 1
            self.values = np.cumprod(grown)
        return self.values


_POWERS = _Powers()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets) over a string column; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray,
               separators: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of the maximal runs of non-separators inside each text."""
    n = len(data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(separators[data], out=inside[1:-1])
    starts_flag = inside[1:-1] & ~inside[:-2]
    ends_flag = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts_flag[cut] = inside[1:-1][cut]
    ends_flag[cut - 1] = inside[1:-1][cut - 1]
    starts = np.flatnonzero(starts_flag)
    ends = np.flatnonzero(ends_flag) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each non-empty, non-overlapping, ascending byte span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    pos = np.arange(total) - np.repeat(first, lens)
    at = pos + np.repeat(starts, lens)
    weighted = (data[at].astype(np.uint64) + np.uint64(1)) * _POWERS.upto(int(lens.max()))[pos]
    return mix64(np.add.reduceat(weighted, first) + lens.astype(np.uint64) * _STEP)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words before each text) of lower-cased bytes."""
    starts, ends, counts = word_spans(data, offsets)
    return span_hashes(data, starts, ends), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle."""
    n = len(hashes)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        rolled = rolled * _BASE + hashes[j:j + len(rolled)]
    rolled = mix64(rolled + np.uint64(k))
    out = []
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist()):
        if b - a >= k:
            s = np.sort(rolled[a:b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for x in hashes[a:b]:
                h = h * _BASE + x
            out.append(mix64(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def give_back() -> None:
    """Return memory that this worker has freed to the system: Arrow's pool and the allocator's heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library has no such call
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving back freed memory between batches and at the end: workers outlive their task."""
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(freed(batches))
        give_back()

    return lean_run
