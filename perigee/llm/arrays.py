"""Words of many texts as numpy arrays: bounds, 64-bit hashes, rolling windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
#: White space between words: space, tab, line feed, vertical tab, form feed, return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], U)
_ODD = U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word (the finisher of a splitmix generator)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of texts that lie one after another in `data`: bounds of each word, and of each
    text the place of its first word (one more entry at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)


def split_words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Words between white space; a word never goes from one text into the next."""
    inside = ~space[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[bounds] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, taken eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, U)
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))
    left = ends - starts
    out = mix(left.astype(U) + _ODD)
    at = starts
    block = eight[at] & _MASK[np.minimum(left, 8)]
    out = mix((out ^ block) * _ODD)
    live = np.flatnonzero(left > 8)
    at, left = at[live] + 8, left[live] - 8
    while len(live):
        block = eight[at] & _MASK[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ block) * _ODD)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


class Rolling:
    """Hashes of every window of consecutive values, of any width, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power = np.full(n + 1, U(_BASE))
        power[0] = 1
        power = np.multiply.accumulate(power)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * power[:-1], out=self.sums[1:])
        back = np.full(n + 1, U(pow(_BASE, -1, 1 << 64)))
        back[0] = 1
        self.back = np.multiply.accumulate(back)

    def windows(self, width: int) -> np.ndarray:
        """The hash of the window that starts at each place where one fits."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n])


def fits(words: Words, width: int) -> np.ndarray:
    """For each place where a window fits into all words: whether it stays in one text."""
    n = max(0, len(words.starts) - width + 1)
    last = np.repeat(words.first[1:], words.per_text)
    return np.arange(n) + width <= last[:n]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of this width that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    edge[:-1] += np.bincount(starts, minlength=n)[:n] if len(starts) else 0
    if len(starts):
        edge[: n + 1] -= np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def sum_per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the values of each text's words."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    if values.dtype.kind == "f":
        out = np.zeros(len(first) - 1)
        full = np.flatnonzero(np.diff(first) > 0)
        if len(full):
            out[full] = np.add.reduceat(values, first[:-1][full])
        return out
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def runs_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
