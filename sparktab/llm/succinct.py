"""Elias-Fano sequences in NumPy arrays that can be memory-mapped, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select_table() -> np.ndarray:
    """Place of the k-th set bit in a byte, least significant first; 8 where there is none."""
    table = np.full((256, 8), 8, np.uint8)
    for byte in range(256):
        for k, bit in enumerate(i for i in range(8) if byte >> i & 1):
            table[byte, k] = bit
    return table


class EliasFano:
    """A monotone sequence of n numbers below ``universe``: low bits packed, high parts as unary gaps in a bit vector."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        self.select = _select_table()

    @staticmethod
    def build(values: np.ndarray) -> "EliasFano":
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
        if low_bits:
            part = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = int(places[-1]) + 2 if n else 1
        bits = np.zeros((size + 63) // 64 * 64 + 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        return EliasFano(n, low_bits, low, high, np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones]

    @staticmethod
    def of(arrays: list[np.ndarray]) -> "EliasFano":
        return EliasFano(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:])

    def _place(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        """Where the k-th one (or zero) stands in the bit vector; counts: how many stand before each 64-bit word."""
        word = np.searchsorted(counts, k, "right") - 1
        rest = k - counts[word]
        bits = self.high[word]
        if flip:
            bits = ~bits
        lanes = np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(lanes), axis=1, dtype=np.int64)
        lane = (upto <= rest[:, None]).sum(axis=1)
        row = np.arange(len(k))
        inside = rest - np.where(lane > 0, upto[row, np.maximum(lane - 1, 0)], 0)
        return word * 64 + lane * 8 + self.select[lanes[row, lane], inside]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (value & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        return ((self._place(i, self.ones, False) - i) << self.low_bits) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and value of the first number >= x; place n and value -1 beyond the last."""
        x = np.asarray(x, np.int64)
        place, value = np.full(len(x), self.n, np.int64), np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return place, value
        last = int(self.get(np.array([self.n - 1]))[0])
        todo = np.flatnonzero(x <= last)
        high, low = x[todo] >> self.low_bits, x[todo] & ((1 << self.low_bits) - 1)
        # numbers with one high part stand between two zeros; their low bits are searched by halving
        begin = np.zeros(len(todo), np.int64)
        some = high > 0
        begin[some] = self._place(high[some] - 1, self.zeros, True) + 1 - high[some]
        end = self._place(high, self.zeros, True) - high
        while True:
            open_ = np.flatnonzero(begin < end)
            if not len(open_):
                break
            middle = (begin[open_] + end[open_]) >> 1
            below = self._low(middle) < low[open_]
            begin[open_[below]] = middle[below] + 1
            end[open_[~below]] = middle[~below]
        place[todo], value[todo] = begin, self.get(begin)
        return place, value
