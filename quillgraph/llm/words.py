"""Vectorised words: 64-bit hashes of all words of a run of texts, and a table from hash to learned value."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import SLICE_BYTES, SPACE_BYTES

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def lut(bytes_in) -> np.ndarray:
    """A table of 256 that is True at the given bytes."""
    out = np.zeros(256, bool)
    out[list(bytes_in)] = True
    return out


SPACE = lut(SPACE_BYTES)
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't in space; no run crosses two texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~space[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    before[offs[:-1][offs[:-1] < n]] = True
    after[offs[1:][offs[1:] > 0] - 1] = True
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def _long_hash(word: np.ndarray) -> int:
    """The sum in hashes() of one long word, a slice at a time."""
    up, _ = _powers(SLICE_BYTES)
    total = 0
    for i in range(0, len(word), SLICE_BYTES):
        part = word[i : i + SLICE_BYTES]
        total += int(((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, i, 1 << 64)
    return total & ((1 << 64) - 1)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, which doesn't depend on where the span stands.

    Words with the same hash are taken as the same word: at a billion different words, that happens
    to one pair with a probability of 3 %.
    """
    if len(data) > 2 * SLICE_BYTES:  # a text that slices() couldn't cut: one long word
        return mix(np.array([_long_hash(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64))
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class WordTable:
    """An open-addressing table from word hashes to row numbers of what learn() has stored.

    learn(words) is called once with each batch of new words (as bytes) and appends one row for
    each. reset() is called when the table holds over cap words, which bounds its memory.
    """

    def __init__(self, learn: Callable[[list[bytes]], None], reset: Callable[[], None], cap: int = 500_000):
        self.learn, self.reset, self.cap = learn, reset, cap
        self._clear(1 << 16)
        self.size = 0

    def _clear(self, slots: int) -> None:
        self.keys, self.rows = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        out = self.rows[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            row = self.rows[slot[left]]
            out[left] = row
            left = left[(row >= 0) & (self.keys[slot[left]] != h[left])]
        return out

    def _insert(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.rows[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.rows[slot[put]] = h[put], rows[put]
            keep = np.ones(len(h), bool)
            keep[put] = False
            h, rows, slot = h[keep], rows[keep], (slot[keep] + 1) & mask

    def index(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row number of each word; words not seen yet are learned."""
        out = self._find(h)
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out
        new, first = np.unique(h[missing], return_index=True)
        if self.size and self.size + len(new) > self.cap:
            self.reset()
            self._clear(1 << 16)
            self.size, missing = 0, np.arange(len(h))
            new, first = np.unique(h, return_index=True)
        at = missing[first]
        raw = data.tobytes()
        self.learn([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        slots = len(self.keys)
        while slots < 3 * (self.size + len(new)):
            slots *= 2
        if slots > len(self.keys):
            full = self.rows >= 0
            old, rows = self.keys[full], self.rows[full]
            self._clear(slots)
            self._insert(old, rows)
        self._insert(new, np.arange(self.size, self.size + len(new), dtype=np.int32))
        self.size += len(new)
        out[missing] = self._find(h[missing])
        return out


class Column:
    """A growing numpy column."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.buf, self.n = np.zeros(1024, self.dtype), 0

    def extend(self, values) -> None:
        values = np.asarray(values, self.dtype)
        if self.n + len(values) > len(self.buf):
            self.buf = np.concatenate([self.buf[: self.n], np.zeros(max(len(self.buf), len(values)), self.dtype)])
        self.buf[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.buf[: self.n]


def sums(values: np.ndarray, word_at: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The sum of the values of the words of each text; word_at: where each word starts."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    at = np.searchsorted(word_at, offs)
    return total[at[1:]] - total[at[:-1]]
