"""Words of whole Arrow text columns as NumPy arrays: where they stand, in which text, and a 64-bit hash of each.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the pattern ``[^\\x20\\x09-\\x0D]+``. Null text has no words.
Hashes are polynomial sums over the bytes modulo 2^64, mixed at the end; two of n distinct words share one with a chance of about n^2 / 2^64.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 20  # bytes hashed at a time; a longer text is one block of its own
_RADIX = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def inverse(base: int) -> int:
    """The inverse of an odd number modulo 2^64."""
    return pow(base, -1, 1 << 64)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column one after another, and the n + 1 places where its texts begin and end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0]: offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


@dataclass
class Words:
    starts: np.ndarray  # byte where each word begins
    ends: np.ndarray  # byte after each word
    first: np.ndarray  # n + 1 numbers: the words of text i are first[i] .. first[i + 1] - 1
    hashes: np.ndarray

    def texts(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def kept_in_worker(key, make):
    """One value for each key and Python process, so that a reused worker reads a vocabulary file once. Meant for a few keys."""
    kept = sys.__dict__.setdefault("_sparktab_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def byte_table(marks: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(marks)] = True
    return table


#: Bytes between words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def words_of(raw: np.ndarray, offs: np.ndarray, fold: bool = False, between: bytes = SPACES, kinds: np.ndarray | None = None) -> Words:
    """All words of the texts in order. ``fold`` lower-cases A-Z in the hashes; ``between`` are the bytes between words.

    ``kinds`` (256 numbers) cuts words where a byte of kind 1 and one of kind 2 meet.
    """
    gap = byte_table(between)
    values = mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    if fold:
        values[65:91] = values[97:123]
    back = inverse(_RADIX)
    parts, at, n = [], 0, len(offs) - 1
    ups = downs = np.zeros(0, np.uint64)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + _BLOCK, "right")) - 1)
        low, high = int(offs[at]), int(offs[to])
        piece = raw[low:high]
        if len(piece):
            inside = ~gap[piece]
            edge = np.zeros(len(piece) + 1, bool)
            edge[offs[at:to + 1] - low] = True
            if kinds is not None:
                kind = kinds[piece]
                edge[1:-1] |= kind[:-1] + kind[1:] * 4 == 6
                edge[1:-1] |= kind[:-1] + kind[1:] * 4 == 9
            before = np.empty(len(piece), bool)
            before[0] = False
            before[1:] = inside[:-1]
            starts = np.flatnonzero(inside & (~before | edge[:-1]))
            after = np.empty(len(piece), bool)
            after[-1] = False
            after[:-1] = inside[1:]
            ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
            if len(ups) <= len(piece):
                ups, downs = powers(_RADIX, len(piece) + 1), powers(back, len(piece) + 1)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(values[piece] * ups[:len(piece)], out=sums[1:])
            parts.append((starts + low, ends + low, mix((sums[ends] - sums[starts]) * downs[starts] + (ends - starts).astype(np.uint64))))
        at = to
    join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
    starts = join(0, np.int64)
    return Words(starts, join(1, np.int64), np.searchsorted(starts, offs), join(2, np.uint64))
