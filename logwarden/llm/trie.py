"""A two-level n-gram trie of Elias-Fano sequences in one memory-mapped file.

Level one holds the context words in ascending order and, for each, where its children begin: two monotone
sequences. Level two holds the children. A child is stored relative to its context: its word's rank plus the
last value of the context before, which makes the level one monotone sequence. A child is found by a
successor search for the shifted rank inside its context's range. Smoothed log probabilities and back-off
weights are codes of 16,384-entry codebooks.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

CODES = 1 << 14
_ONE = np.uint64(1)


class EliasFano:
    """A monotone sequence: low bits packed, upper bits in unary. All queries are vectorised."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, upper: np.ndarray):
        self.n, self.low_bits, self.low, self.upper = n, low_bits, low, upper
        ones = np.bitwise_count(upper).astype(np.int64)
        self._ones = np.concatenate([[0], np.cumsum(ones)])
        self._zeros = np.arange(len(upper) + 1, dtype=np.int64) * 64 - self._ones

    @staticmethod
    def pack(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Size, low bits, and the two arrays of words of ascending values."""
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            part = values & ((_ONE << np.uint64(low_bits)) - _ONE)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(low_bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros((int(place[-1]) if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(upper, place // 64, _ONE << (place % 64).astype(np.uint64))
        return n, low_bits, low, upper

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        carried = (self.low[word + 1] << (np.uint64(63) - shift)) << _ONE
        return ((self.low[word] >> shift) | carried) & ((_ONE << np.uint64(self.low_bits)) - _ONE)

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th set bit (or clear bit), from 0."""
        word = np.searchsorted(before, k, "right") - 1
        left = k - before[word]
        bits = self.upper[word]
        if flip:
            bits = ~bits
        place = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & ((_ONE << np.uint64(half)) - _ONE)).astype(np.int64)
            go = left >= below
            left = left - np.where(go, below, 0)
            place += np.where(go, half, 0)
            bits = np.where(go, bits >> np.uint64(half), bits)
        return word * 64 + place

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, self._ones, False) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(i)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have upper bits less than ``high``."""
        within = np.clip(high, 1, int(self._zeros[-1]))
        found = self._select(within - 1, self._zeros, True) - (within - 1)
        return np.where(high <= 0, 0, np.where(high > self._zeros[-1], self.n, found))

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in [begin, end) whose value is at least x, else end; and whether it is x."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        low = x & ((_ONE << np.uint64(self.low_bits)) - _ONE)
        lo = np.clip(self._below(high), begin, end)
        stop = np.clip(self._below(high + 1), begin, end)
        hi = stop.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            less = self._lows(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        inside = np.flatnonzero(lo < stop)
        same = np.zeros(len(x), bool)
        same[inside] = self._lows(lo[inside]) == low[inside]
        return lo, same


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codebook of the means of equally wide bins, and the code of each value; few distinct values stay exact."""
    distinct, code = np.unique(values, return_inverse=True)
    if len(distinct) > CODES:
        low, width = distinct[0], (distinct[-1] - distinct[0]) / CODES
        bins, code = np.unique(np.minimum((values - low) / width, CODES - 1).astype(np.int64), return_inverse=True)
        distinct = np.bincount(code, values) / np.bincount(code)
    return (distinct if len(distinct) else np.zeros(1)), code.astype(np.uint16)


class Trie:
    """Contexts with their successors, probabilities and back-off weights; a file while it is open."""

    def __init__(self, contexts: np.ndarray, starts: np.ndarray, words: np.ndarray, log_p: np.ndarray, log_backoff: np.ndarray):
        """``contexts``: ascending; ``starts``: where each one's ``words`` begin, and the end; words ascend in a context."""
        last = words[starts[1:] - 1].astype(np.uint64) if len(contexts) else np.empty(0, np.uint64)
        base = np.concatenate([[np.uint64(0)], np.cumsum(last, dtype=np.uint64)])
        shifted = words.astype(np.uint64) + np.repeat(base[:-1], np.diff(starts))
        self._file = tempfile.TemporaryFile()
        self._map: mmap.mmap | None = None
        places = []
        sequences = [EliasFano.pack(contexts), EliasFano.pack(starts), EliasFano.pack(shifted)]
        (self._p, p_codes), (self._backoff, backoff_codes) = quantised(log_p), quantised(log_backoff)
        for array in [a for s in sequences for a in s[2:]] + [p_codes, backoff_codes]:
            self._file.write(b"\0" * (-self._file.tell() % 8))
            places.append((self._file.tell(), array.dtype, len(array)))
            self._file.write(array.tobytes())
        self._file.write(b"\0" * 8)
        self._file.flush()
        self._map = mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ)
        mapped = [np.frombuffer(self._map, dtype, n, at) for at, dtype, n in places]
        self.contexts, self.pointers, self.children = (
            EliasFano(s[0], s[1], mapped[2 * k], mapped[2 * k + 1]) for k, s in enumerate(sequences)
        )
        self._p_codes, self._backoff_codes = mapped[6], mapped[7]

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each pair is there; its log probability, else the context's back-off weight (0 if unknown)."""
        n = self.contexts.n
        if not n or not len(context):
            return np.zeros(len(context), bool), np.zeros(len(context)), np.zeros(len(context))
        at, known = self.contexts.successor(context, np.zeros(len(context), np.int64), np.full(len(context), n))
        at = np.where(known, at, 0)
        begin = self.pointers.get(at).astype(np.int64)
        end = self.pointers.get(at + 1).astype(np.int64)
        base = np.where(begin > 0, self.children.get(np.maximum(begin - 1, 0)), np.uint64(0))
        place, same = self.children.successor(base + word.astype(np.uint64), begin, end)
        found = known & same
        log_p = np.where(found, self._p[self._p_codes[np.where(found, place, 0)]], 0.0)
        backoff = np.where(known, self._backoff[self._backoff_codes[at]], 0.0)
        return found, log_p, backoff

    def close(self) -> None:
        self._file.close()
