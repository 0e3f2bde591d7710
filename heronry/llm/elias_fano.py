"""Elias-Fano sequences and a two-level n-gram trie over them, in numpy and searched in place.

A sequence of n non-decreasing integers below u keeps the low bits of each in a packed array and
the rest as unary gaps in a bit array: about 2 + log2(u / n) bits a value. A sampled count of ones
makes both the i-th value and the first value not below x a matter of one block, so nothing is
unpacked to be searched, and the bytes may lie in a memory-mapped file.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

_BLOCK = 8  # bytes of the bit array between two samples
_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th one of a byte.
_SELECT = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _ones = [i for i in range(8) if _byte >> i & 1]
    _SELECT[_byte, : len(_ones)] = _ones
#: Queries looked up at a time; more would only leave the processor's cache.
_STEP = 1 << 15


class EliasFano:
    """``low`` and ``high`` are bytes; ``sample`` has the ones before each block of ``high``."""

    def __init__(self, n: int, bound: int, bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.bound, self.bits, self.low, self.high, self.sample = n, bound, bits, low, high, sample
        self._zeros = np.arange(len(sample), dtype=np.int64) * (8 * _BLOCK) - sample

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        """``values`` are non-decreasing and below ``bound``."""
        values = values.astype(np.int64)
        n = len(values)
        bits = max(0, int(bound // max(n, 1)).bit_length() - 1)
        low = np.zeros(-(-n * bits // 8) + 8, np.uint8)
        shifts = np.arange(bits, dtype=np.int64)
        for i in range(0, n if bits else 0, _STEP):  # a multiple of eight values, so of whole bytes
            packed = np.packbits((values[i : i + _STEP, None] >> shifts & 1).astype(np.uint8).ravel(), bitorder="little")
            low[i * bits // 8 : i * bits // 8 + len(packed)] = packed
        places = (values >> bits) + np.arange(n)
        flags = np.zeros(-(-(n + (bound >> bits) + 1) // (8 * _BLOCK)) * 8 * _BLOCK, np.uint8)
        flags[places] = 1
        high = np.packbits(flags, bitorder="little")
        ones = _POP[high].reshape(-1, _BLOCK).sum(1, dtype=np.int64)
        return cls(n, bound, bits, low, high, (np.cumsum(ones) - ones).astype(np.int64))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.bound, self.bits, len(self.low), len(self.high)], np.int64)
        return b"".join((head.tobytes(), self.sample.astype("<u4").tobytes(), self.low.tobytes(), self.high.tobytes()))

    @classmethod
    def read(cls, data: np.ndarray) -> EliasFano:
        """From bytes; the large arrays are views of ``data``."""
        n, bound, bits, n_low, n_high = np.frombuffer(data[:40].tobytes(), np.int64).tolist()
        at = 40 + 4 * (n_high // _BLOCK)
        sample = np.frombuffer(data[40:at].tobytes(), "<u4").astype(np.int64)
        return cls(n, bound, bits, data[at : at + n_low], data[at + n_low : at + n_low + n_high], sample)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Places of the k-th ones or zeros of ``high``, counted from 0."""
        before = self.sample if ones else self._zeros
        block = np.searchsorted(before, k, "right") - 1
        rest = k - before[block]
        rows = np.asarray(self.high).reshape(-1, _BLOCK)[block]
        if not ones:
            rows = ~rows
        pops = _POP[rows]
        sums = np.cumsum(pops, axis=1, dtype=np.uint8)
        byte = (sums <= rest[:, None].astype(np.uint8)).sum(1)
        each = np.arange(len(k))
        rest -= sums[each, byte] - pops[each, byte]
        return block * (8 * _BLOCK) + byte * 8 + _SELECT[rows[each, byte], rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        words = np.asarray(self.low)[(at >> 3)[:, None] + np.arange(8)].view("<u8").ravel()
        return (words >> (at & 7).astype(np.uint64) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def values(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        parts = [((self._select(p, True) - p) << self.bits) | self._low(p) for p in _steps(i)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def successors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each x, from 0 to below the bound, the index of the first value not below it (n if none), and whether that equals x."""
        places, same = [], []
        for p in _steps(np.asarray(x, np.int64)):
            h = p >> self.bits
            left = np.zeros(len(p), np.int64)
            some = h > 0
            left[some] = self._select(h[some] - 1, False) - (h[some] - 1)
            end = self._select(h, False) - h
            right, wanted = end.copy(), p & ((1 << self.bits) - 1)
            while (open_ := left < right).any():
                middle = (left + right) >> 1
                less = open_.copy()
                less[open_] = self._low(middle[open_]) < wanted[open_]
                left = np.where(less, middle + 1, left)
                right = np.where(open_ & ~less, middle, right)
            hit = left < end
            hit[hit] = self._low(left[hit]) == wanted[hit]
            places.append(left)
            same.append(hit)
        return (np.concatenate(places), np.concatenate(same)) if places else (np.zeros(0, np.int64), np.zeros(0, bool))


def _steps(x: np.ndarray) -> Iterator[np.ndarray]:
    return (x[i : i + _STEP] for i in range(0, len(x), _STEP))


class Trie:
    """Contexts, pointers to their successors, and the successors with a 16-bit code each.

    Successors of the i-th context are stored as ``i * width + word``, so the whole level is one
    increasing sequence, and a word is searched relative to its context. Code 0 is no code.
    """

    LEVELS = ("contexts", "pointers", "successors", "codes")

    def __init__(self, width: int, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.width, self.contexts, self.pointers, self.successors, self.codes = width, contexts, pointers, successors, codes

    @classmethod
    def levels(cls, width: int, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, codes: np.ndarray) -> list[bytes]:
        """The levels as bytes, of increasing ``contexts`` with ``sizes`` increasing ``words`` each, all below ``width``."""
        rank = np.repeat(np.arange(len(contexts), dtype=np.int64), sizes)
        ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        built = (EliasFano.of(contexts, width), EliasFano.of(ends, len(words) + 1), EliasFano.of(rank * width + words, max(1, len(contexts)) * width))
        return [*(level.to_bytes() for level in built), codes.astype("<u2").tobytes()]

    @classmethod
    @contextmanager
    def mapped(cls, width: int, levels: list[bytes]) -> Iterator[Trie]:
        """The trie over a memory-mapped file of its levels, which goes afterwards."""
        with tempfile.TemporaryFile() as file:
            starts = []
            for level in levels:
                file.write(bytes(-file.tell() % 8))
                starts.append(file.tell())
                file.write(level)
            file.flush()
            whole = np.memmap(file, np.uint8, "r")
            parts = [whole[a : a + len(level)] for a, level in zip(starts, levels)]
            yield cls(width, *map(EliasFano.read, parts[:3]), np.asarray(parts[3]).view("<u2"))

    def find(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words after their contexts (``sizes`` words each), and each context's number of successors."""
        at, known = self.contexts.successors(contexts)
        n = np.zeros(len(contexts), np.int64)
        some = at[known]
        first = self.pointers.values(some)
        n[known] = self.pointers.values(some + 1) - first
        codes = np.zeros(len(words), np.uint16)
        asked = np.repeat(known, sizes)
        place, hit = self.successors.successors(np.repeat(at, sizes)[asked] * self.width + words[asked])
        found = np.zeros(len(place), np.uint16)
        found[hit] = self.codes[place[hit]]
        codes[asked] = found
        return codes, n
