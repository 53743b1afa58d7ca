"""Elias-Fano sequences and a two-level trie of them, in NumPy, queried many at a time.

A monotone sequence is kept as the low bits of each value, packed, and the high bits in unary, with the
number of zeros before each word of 64 bits.  ``Trie`` has three: the contexts, the monotone pointers from
each to its successors, and the successors, where those of a context follow on from the last of the
context before, so that one sequence holds all of them.  A probability is a code of 8 bits.  All of a
trie is one block of bytes, which can be a memory-mapped file.
"""

from __future__ import annotations

import numpy as np

WORD = 64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits side by side, and one word more."""
    n = len(values)
    out = np.zeros(n * width // WORD + 2, np.uint64)
    if width and n:
        at = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero(shift + np.uint64(width) > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out


class EliasFano:
    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        zeros = WORD - np.bitwise_count(high).astype(np.int64)
        self.zeros = np.concatenate([[0], np.cumsum(zeros)])
        self.ones = np.arange(len(self.zeros)) * WORD - self.zeros

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max((top // n).bit_length() - 1, 0) if n else 0
        low = _pack(values & np.uint64((1 << width) - 1), width)
        bits = np.zeros(-(-(n + (top >> width) + 1) // WORD) * WORD, np.uint8)
        bits[((values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)).astype(np.int64)] = 1
        return EliasFano(n, width, low, np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        beyond = (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return ((self.low[word] >> shift) | beyond) & np.uint64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Positions of the k-th bits that are one (zero with ``flip``)."""
        block = np.searchsorted(before, k, "right") - 1
        word = self.high[np.minimum(block, len(self.high) - 1)]
        if flip:
            word = ~word
        left, at = (k - before[block]).astype(np.int64), np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            part = (word >> at.astype(np.uint64)) & np.uint64((1 << half) - 1)
            n = np.bitwise_count(part).astype(np.int64)
            beyond = left >= n
            left, at = np.where(beyond, left - n, left), np.where(beyond, at + half, at)
        return block * WORD + at

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, self.ones, False) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def rank(self, x: np.ndarray) -> np.ndarray:
        """The number of values below each x: the place of its successor."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.width)).astype(np.int64)
        most = int(self.zeros[-1])
        out = np.full(len(x), self.n, np.int64)
        inside = np.flatnonzero(high < most)
        h, target = high[inside], x[inside] & np.uint64((1 << self.width) - 1)
        lo = np.zeros(len(h), np.int64)
        later = h > 0
        lo[later] = self._select(h[later] - 1, self.zeros, True) - (h[later] - 1)
        hi = np.minimum(self._select(h, self.zeros, True) - h, self.n)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            below = self._low(mid) < target[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        out[inside] = lo
        return out

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width, len(self.low), len(self.high)], np.uint64), self.low, self.high]

    @staticmethod
    def read(words: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, width, low, high = (int(x) for x in words[at : at + 4])
        a = at + 4
        return EliasFano(n, width, words[a : a + low], words[a + low : a + low + high]), a + low + high


class Trie:
    """Codes of (context, successor) pairs."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @staticmethod
    def build(context: np.ndarray, successor: np.ndarray, codes: np.ndarray) -> bytes:
        """From pairs in ascending order, none twice."""
        new = np.concatenate([[True], context[1:] != context[:-1]]) if len(context) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        ends = np.concatenate([first[1:], [len(context)]]) if len(first) else first
        last = successor[ends - 1].astype(np.uint64) + np.uint64(1) if len(first) else np.zeros(0, np.uint64)
        base = np.cumsum(last) - last
        relative = successor.astype(np.uint64) + np.repeat(base, ends - first)
        parts = []
        for values in (context[first], np.concatenate([first, [len(context)]]), relative):
            parts += EliasFano.of(values).arrays()
        words = np.concatenate([x.astype(np.uint64) for x in parts])
        return len(words).to_bytes(8, "little") + words.tobytes() + codes.astype(np.uint8).tobytes()

    @staticmethod
    def read(data) -> Trie:
        """From bytes or a memory map of them."""
        n = int.from_bytes(bytes(data[:8]), "little")
        words = np.frombuffer(data, np.uint64, n, 8)
        contexts, at = EliasFano.read(words, 0)
        pointers, at = EliasFano.read(words, at)
        successors, _ = EliasFano.read(words, at)
        return Trie(contexts, pointers, successors, np.frombuffer(data, np.uint8, successors.n, 8 + 8 * n))

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The place of each pair among the trie's, whose code is there; -1 for one that there is none of."""
        out = np.full(len(context), -1, np.int64)
        if not self.contexts.n:
            return out
        # Each run of equal contexts is looked up once.
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        run, own = np.cumsum(new) - 1, context[new].astype(np.uint64)
        i = self.contexts.rank(own)
        known = np.flatnonzero(i < self.contexts.n)
        known = known[self.contexts.get(i[known]) == own[known]]
        i = i[known]
        first, end = (np.zeros(len(own), np.int64) for _ in range(2))
        base = np.zeros(len(own), np.uint64)
        first[known], end[known] = self.pointers.get(i).astype(np.int64), self.pointers.get(i + 1).astype(np.int64)
        later = np.flatnonzero(first > 0)
        base[later] = self.successors.get(first[later] - 1) + np.uint64(1)
        there = np.flatnonzero(end[run])
        run = run[there]
        end, target = end[run], base[run] + successor[there].astype(np.uint64)
        at = self.successors.rank(target)
        hit = np.flatnonzero(at < end)
        hit = hit[self.successors.get(at[hit]) == target[hit]]
        out[there[hit]] = at[hit]
        return out
