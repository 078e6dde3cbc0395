"""Token ids of whole texts from a library tokenizer, by pieces that cannot share a token.

Words recur, so a worker keeps the ids of the pieces it has seen and asks the library
only for new ones. Texts are cut only where no token can reach across, which makes the
joined ids those of the whole text (tested against the library on whole texts).

Pieces are spans of a byte array. Up to ``KEY_BYTES`` bytes they are three 64-bit words
in an open hash table of numpy arrays, compared whole, so looking up a batch takes a few
array operations; longer pieces are in a dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .text import mix64

#: Slots of a table (a power of two), filled to FILL; bytes of text, and pieces, taken at a time.
SLOTS, FILL, GROUP_BYTES, CHUNK = 1 << 20, 0.6, 1 << 19, 1 << 17
KEY_BYTES = 24
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Table:
    """One generation: keys, lengths, and for every kind of value where a piece's ids are and how many."""

    def __init__(self, values: int, slots: int) -> None:
        self.mask, self.used = slots - 1, 0
        self.keys = np.zeros((3, slots), np.uint64)
        self.lens = np.zeros(slots, np.uint8)
        self.at, self.n = np.zeros((values, slots), np.uint32), np.zeros((values, slots), np.uint8)
        self.ids, self.ends = [np.zeros(1 << 12, np.int32) for _ in range(values)], [0] * values
        self.long: dict[bytes, tuple] = {}

    def put(self, lists: list[list]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Append the ids of new pieces, one list of ids lists a kind; (where, how many) of each."""
        at, n = [], []
        for v, ids in enumerate(lists):
            many = np.fromiter(map(len, ids), np.int64, len(ids))
            end = self.ends[v] + int(many.sum())
            if end > len(self.ids[v]):
                self.ids[v] = np.concatenate((self.ids[v], np.zeros(max(end, len(self.ids[v])), np.int32)))
            self.ids[v][self.ends[v]:end] = np.fromiter((i for x in ids for i in x), np.int32, end - self.ends[v])
            at.append(self.ends[v] + np.cumsum(many) - many)
            n.append(many)
            self.ends[v] = end
        return at, n

    def find(self, keys: np.ndarray, lens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        found, slot, todo = np.full(len(lens), -1, np.int64), first.copy(), np.arange(len(lens))
        while len(todo):
            s = slot[todo]
            there = self.lens[s]
            same = there == lens[todo]
            for k in range(3):
                same &= self.keys[k][s] == keys[k][todo]
            found[todo[same]] = s[same]
            todo = todo[~same & (there != 0)]
            slot[todo] = (slot[todo] + 1) & self.mask
        return found

    def add(self, keys: np.ndarray, lens: np.ndarray, first: np.ndarray, at: list[np.ndarray], n: list[np.ndarray]) -> None:
        """Distinct keys that are not in the table."""
        slot, todo = first.copy(), np.arange(len(lens))
        while len(todo):
            s, pick = np.unique(slot[todo], return_index=True)
            free = self.lens[s] == 0
            s, new = s[free], todo[pick[free]]
            self.lens[s] = lens[new]
            self.keys[:, s] = keys[:, new]
            for v in range(len(at)):
                self.at[v][s], self.n[v][s] = at[v][new], n[v][new]
            todo = np.setdiff1d(todo, new, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask
        self.used += len(lens)


class Kept:
    """What ``compute`` gave for the pieces seen last.

    ``compute`` takes a list of distinct pieces (bytes) and gives, for each kind of value, a list of ids
    lists. Two generations: a piece found in the older one moves to the younger one, so what is used
    stays and the rest goes when a generation is full.
    """

    def __init__(self, compute: Callable[[list[bytes]], list[list]], values: int = 1, slots: int = SLOTS) -> None:
        self.compute, self.values, self.slots = compute, values, slots
        self.young, self.old = _Table(values, slots), _Table(values, 1)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind of value (ids of all pieces, number of ids of each piece)."""
        padded = np.concatenate((data, np.zeros(KEY_BYTES + 8, np.uint8)))
        words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        step = min(CHUNK, max(1, self.slots // 4))
        parts = [self._some(data, words, starts[a:a + step], ends[a:a + step]) for a in range(0, len(starts), step)]
        return [(np.concatenate([np.zeros(0, np.int32), *(p[v][0] for p in parts)]),
                 np.concatenate([np.zeros(0, np.int64), *(p[v][1] for p in parts)])) for v in range(self.values)]

    def _some(self, data: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
        if self.young.used + len(self.young.long) > FILL * self.slots:
            self.old, self.young = self.young, _Table(self.values, self.slots)
        young, old, sizes = self.young, self.old, ends - starts
        short = np.flatnonzero(sizes <= KEY_BYTES)
        lens, first_byte = sizes[short].astype(np.uint8), starts[short]
        keys = np.stack([words[first_byte + 8 * k] & _MASKS[np.clip(sizes[short] - 8 * k, 0, 8)] for k in range(3)])
        slot = (mix64(keys[0] ^ keys[1] * _ODD[0] ^ keys[2] * _ODD[1]) & np.uint64(self.slots - 1)).astype(np.int64)
        found = young.find(keys, lens, slot)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            _, once = np.unique(keys[:, miss] ^ lens[miss].astype(np.uint64)[None] * _ODD[0], axis=1, return_index=True) \
                if len(miss) > 1 else (None, np.zeros(1, np.int64))
            new = miss[np.sort(once)]
            if old.used:
                was = old.find(keys[:, new], lens[new], slot[new] & old.mask)
                again, s = new[was >= 0], was[was >= 0]
                lists = [[old.ids[v][a:a + n] for a, n in zip(old.at[v][s].tolist(), old.n[v][s].tolist())] for v in range(self.values)]
                young.add(keys[:, again], lens[again], slot[again], *young.put(lists))
                new = new[was < 0]
            if len(new):
                raw = [data[a:b].tobytes() for a, b in zip(starts[short[new]].tolist(), ends[short[new]].tolist())]
                young.add(keys[:, new], lens[new], slot[new], *young.put(self.compute(raw)))
            found[miss] = young.find(keys[:, miss], lens[miss], slot[miss])
        where = [np.zeros(len(starts), np.int64) for _ in range(self.values)]
        many = [np.zeros(len(starts), np.int64) for _ in range(self.values)]
        for v in range(self.values):
            where[v][short], many[v][short] = young.at[v][found], young.n[v][found]
        self._long(data, starts, ends, np.flatnonzero(sizes > KEY_BYTES), where, many)
        out = []
        for v in range(self.values):
            before = np.cumsum(many[v]) - many[v]
            out.append((young.ids[v][np.repeat(where[v] - before, many[v]) + np.arange(int(many[v].sum()))], many[v]))
        return out

    def _long(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, where: list, many: list) -> None:
        young, old = self.young, self.old
        raw = [data[a:b].tobytes() for a, b in zip(starts[rows].tolist(), ends[rows].tolist())]
        fresh = [p for p in dict.fromkeys(raw) if p not in young.long]
        kept = [p for p in fresh if p in old.long]
        fresh = [p for p in fresh if p not in old.long]
        for names, lists in ((kept, [[old.ids[v][a:a + n] for a, n in (old.long[p][v] for p in kept)] for v in range(self.values)]),
                             (fresh, self.compute(fresh) if fresh else [[] for _ in range(self.values)])):
            at, n = young.put(lists)
            for i, p in enumerate(names):
                young.long[p] = tuple((int(at[v][i]), int(n[v][i])) for v in range(self.values))
        for i, p in zip(rows.tolist(), raw):
            for v, (a, n) in enumerate(young.long[p]):
                where[v][i], many[v][i] = a, n


def groups(sizes: list[int], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs (first, last + 1) of texts of about ``limit`` bytes, or of one longer text."""
    a = size = 0
    for b, n in enumerate(sizes):
        if size and size + n > limit:
            yield a, b
            a, size = b, 0
        size += n
    if a < len(sizes):
        yield a, len(sizes)
