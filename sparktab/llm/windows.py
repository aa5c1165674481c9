"""Substring dedup: words covered by windows whose word sequence starts anywhere else are removed.

Every fixed-length window of words gets a Rabin-Karp hash: with word hashes h and an odd radix r modulo 2^64, running sums of h[j] * r^-j
give the hash of any window by one subtraction and one product. Chunks count their own windows and ask shards of the hash space, which
count across all chunks; runs of repeated windows merge into maximal intervals of words to remove. Shards are ranges of hashes, so a
passage in a third of all texts puts one entry per chunk into each of many shards, and no shard grows with the copies of one window.

Two different windows among n share a hash with a chance of about n^2 / 2^65 (below 10^-3 for 10^8 windows of text).

Null and empty texts have no words and no windows; texts shorter than the window lose nothing. Repeated rows are texts of their own, so
exact copies of at least one window lose all covered words, the first copy included. An empty table gives an empty result. Extra columns
are carried by ``remove_repeats`` as they are and may have any name.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exchange import ask_and_finish, chunk_count, others, records, replies, text_bytes, with_chunks, with_columns
from .words import flat, inverse, mix, powers, words_of

WINDOW = 35
#: Hashes that one shard counts.
SHARD_HASHES = 2_000_000
_RADIX = 0xA0761D6478BD642F


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the hash of each window that lies in one text."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(inverse(_RADIX), n), out=sums[1:])
    hashes = mix((sums[size:] - sums[:-size]) * powers(_RADIX, n - size + 1))
    inside = np.ones(n - size + 1, bool)
    for end in first[1:-1]:
        inside[max(0, end - size + 1): end] = False
    at = np.flatnonzero(inside)
    return at, hashes[at]


def shard_bounds(sorted_hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of hashes begins and ends among sorted hashes."""
    cuts = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, cuts), [len(sorted_hashes)]])


def intervals(covered: np.ndarray, at: np.ndarray, repeated: np.ndarray, size: int) -> np.ndarray:
    """Marks the words that repeated windows cover; overlapping windows make one interval."""
    step = np.zeros(len(covered) + 1, np.int32)
    np.add.at(step, at[repeated], 1)
    np.add.at(step, at[repeated] + size, -1)
    return np.cumsum(step[:-1]) > 0


def cut_out(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text from its first kept word on, without the removed runs of words: what stood after a kept run joins it to the next."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]])))
    runs = edges.reshape(-1, 2).tolist()  # kept words a .. b - 1
    parts = []
    for k, (a, b) in enumerate(runs):
        parts.append(text[starts[a]:ends[b - 1]])
        if k + 1 < len(runs):
            parts.append(text[ends[b - 1]:starts[b]])
    return b"".join(parts)


def removal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shard_hashes: int = SHARD_HASHES) -> DataFrame:
    """All columns of ``docs`` but the text, then n_words, n_removed and ``kept``: the words that stay, joined by one space.

    ``kept`` has the same words as the text where nothing is removed.
    """
    n_bytes, _ = text_bytes(docs, text)
    chunked = with_chunks(docs, doc_id, text, chunk_count(n_bytes))
    shards = max(1, -(-n_bytes // (6 * shard_hashes)))  # a word and its gap take about six bytes
    out = marked(chunked, window, shards)
    return out.toDF(*others(docs, text), "n_words", "n_removed", "kept")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows and columns of ``docs``. A text loses the removed intervals and the white space after them; the rest, lines included, stays as it is."""
    names, at = docs.columns, docs.columns.index(text)
    n_bytes, _ = text_bytes(docs, text)
    chunked = with_chunks(docs, doc_id, text, chunk_count(n_bytes))
    out = marked(chunked, window, max(1, -(-n_bytes // (6 * SHARD_HASHES))), whole=True)
    rest = [f"c{i}" for i in range(len(names) - 1)]
    return out.select(*rest[:at], F.col("kept").cast(docs.schema[at].dataType), *rest[at:]).toDF(*names)


def marked(chunked: DataFrame, window: int, shards: int, whole: bool = False) -> DataFrame:
    """The carried columns, n_words, n_removed and kept. ``whole``: a text that loses nothing is kept letter by letter."""

    def look(texts: pa.Table):
        raw, offs = flat(texts["text"])
        words = words_of(raw, offs)
        at, hashes = window_hashes(words.hashes, words.first, window)
        return raw, offs, words, at, hashes

    def ask(texts: pa.Table) -> pa.Table:
        hashes = np.unique(look(texts)[4])
        ends = shard_bounds(hashes, shards)
        return records(texts["chunk"][0].as_py(), [(s, hashes[ends[s]:ends[s + 1]].tobytes()) for s in range(shards) if ends[s] < ends[s + 1]])

    def answer(asked: pa.Table) -> pa.Table:
        own = [np.frombuffer(b, np.uint64) for b in asked["payload"].to_pylist()]
        every = np.sort(np.concatenate(own))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        found = [np.isin(h, twice, assume_unique=True) for h in own]
        return replies(asked, [np.packbits(f).tobytes() for f in found])

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        raw, offs, words, at, hashes = look(texts)
        distinct, inverse_, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        repeated = counts > 1
        ends = shard_bounds(distinct, shards)
        for s, bits in zip(answers["shard"].to_pylist(), answers["payload"].to_pylist()):
            low, high = ends[s], ends[s + 1]
            repeated[low:high] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low).astype(bool)
        gone = intervals(np.zeros(len(words.hashes), bool), at, repeated[inverse_] if len(at) else np.zeros(0, bool), window)
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) * (np.diff(words.first) > 0)
        text, stay, kept = raw.tobytes(), (~gone).tolist(), []
        nulls = texts["text"].is_null().to_pylist()
        for i in range(texts.num_rows):
            own = text[offs[i]:offs[i + 1]]
            if removed[i]:
                a, b = words.first[i], words.first[i + 1]
                kept.append(cut_out(text, words.starts[a:b], words.ends[a:b], gone[a:b]) if whole else b" ".join(compress(own.split(), stay[a:b])))
            else:
                kept.append((None if nulls[i] else own) if whole else b" ".join(own.split()))
        return with_columns(texts, {"n_words": np.diff(words.first), "n_removed": removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return ask_and_finish(chunked, ask, answer, finish, "n_words bigint, n_removed bigint, kept string")
