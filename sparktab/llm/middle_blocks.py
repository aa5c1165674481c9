"""Fill-in-the-middle order of texts by block rotation inside one buffer, and the way back.

A text is cut at two of its line ends (drawn from digests of seed and id, so that no retry or partitioning changes them) into prefix, middle and
suffix. The sentinels go into a bytearray between the blocks, in text order, and one rotation exchanges the two blocks that stand in the wrong
order: middle and suffix for ``psm`` (prefix, suffix, middle), everything before the suffix and the suffix for ``spm`` (suffix, prefix, middle).
A rotation is three reversals in place, so besides its buffer a text of any length needs ``REVERSED`` bytes. ``restored`` finds the sentinels
in the output, rotates back and takes them out; it reads nothing but output and form.

A text that holds a sentinel, an empty one and one past ``rate`` stay as they are (form ``plain``); so a sentinel in an output is always one that was
put in. Null texts are empty ones. A null id draws as the seed alone. Rows are worked on one by one: repeated rows give equal results,
empty tables empty ones, and other columns pass through, whatever their names; the added ones come last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
#: Bytes that a reversal holds beside the buffer.
REVERSED = 1 << 16
#: Bytes of text after which a batch of results is handed over.
HANDED = 4 << 20


def reverse(view: np.ndarray, low: int, high: int) -> None:
    """Reverse view[low:high] in place, block by block from both ends."""
    half = REVERSED // 2
    while high - low > REVERSED:
        head = view[low:low + half].copy()
        view[low:low + half] = view[high - half:high][::-1]
        view[high - half:high] = head[::-1]
        low, high = low + half, high - half
    view[low:high] = view[low:high][::-1].copy()


def rotate(view: np.ndarray, low: int, middle: int, high: int) -> None:
    """Exchange view[low:middle] and view[middle:high] in place."""
    reverse(view, low, middle)
    reverse(view, middle, high)
    reverse(view, low, high)


def draws(seed: int, key: str) -> list[int]:
    """Four unsigned 32-bit numbers of the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12)]


def line_ends(raw: bytes | np.ndarray) -> np.ndarray:
    """0 and the byte after each line; the last line needs no line end."""
    view = np.frombuffer(raw, np.uint8) if isinstance(raw, (bytes, bytearray)) else raw
    ends = np.flatnonzero(view == 10) + 1
    if len(view) and (not len(ends) or ends[-1] != len(view)):
        ends = np.append(ends, len(view))
    return np.concatenate([[0], ends])


def characters(view: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((view & 0xC0) != 0x80))


def moved(raw: bytes, key: str, seed: int, rate: int, spm_rate: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, bytes]:
    """n lines, form, code points of prefix and middle, output."""
    marks = [s.encode() for s in sentinels]
    ends = line_ends(raw)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, key)
    if not raw or any(m in raw for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, raw
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = int(ends[low]), int(ends[high])
    view = np.frombuffer(raw, np.uint8)
    counts = characters(view[:a]), characters(view[a:b])
    buffer = bytearray(raw)
    buffer[b:b] = marks[1]
    buffer[a:a] = marks[2]
    buffer[0:0] = marks[0]
    at_middle = len(marks[0]) + a
    at_suffix = len(marks[0]) + len(marks[2]) + b
    form = "spm" if h4 % 100 < spm_rate else "psm"
    rotate(np.frombuffer(buffer, np.uint8), 0 if form == "spm" else at_middle, at_suffix, len(buffer))
    return n, form, *counts, bytes(buffer)


def moved_back(raw: bytes, form: str, sentinels: tuple[str, str, str]) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return raw
    prefix, suffix, middle = (s.encode() for s in sentinels)
    buffer = bytearray(raw)
    view = np.frombuffer(buffer, np.uint8)
    if form == "spm":
        low, cut = 0, raw.index(prefix)
    else:
        low, cut = raw.index(suffix), raw.index(middle)
    rotate(view, low, cut, len(buffer))
    del view
    at_middle = buffer.index(middle) if form == "spm" else low
    at_suffix = len(buffer) - (cut - low)
    del buffer[at_suffix:at_suffix + len(suffix)]
    del buffer[at_middle:at_middle + len(middle)]
    del buffer[:len(prefix)]
    return bytes(buffer)


def _with_positions(docs: DataFrame, named: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Columns as x0, x1, ... so that no names clash, then the named ones as strings."""
    names = docs.columns
    flat = docs.toDF(*(f"x{i}" for i in range(len(names))))
    return flat.select("*", *(F.col(f"x{names.index(c)}").cast("string").alias(k) for k, c in named.items())), names


def _handed(batches, work, kinds: list[tuple[str, pa.DataType]]):
    """The columns x0, x1, ... and those that ``work`` gives for each row, in batches of bounded bytes."""
    for batch in batches:
        kept = [i for i, name in enumerate(batch.schema.names) if name.startswith("x")]
        low, rows, size = 0, [], 0
        for at in range(batch.num_rows):
            row, weight = work(batch, at)
            rows.append(row)
            size += weight
            if size >= HANDED or at + 1 == batch.num_rows:
                part = batch.slice(low, at + 1 - low)
                added = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
                added = [a.cast(pa.string()) if a.type == pa.binary() else a for a in added]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *added], [*(batch.schema.names[i] for i in kept), *(name for name, _ in kinds)])
                low, rows, size = at + 1, [], 0


def rearranged(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """All columns, then n, form, prefix_chars, middle_chars and output.

    ``rate`` and ``spm_rate`` are the hundredths of texts that are rearranged and of those that become ``spm``. Sentinels are tags: ``<``, letters, ``>``.
    """
    if len({*sentinels}) != 3 or not all(s[:1] == "<" and s[-1:] == ">" and s.count("<") + s.count(">") == 2 for s in sentinels):
        raise ValueError("sentinels are three different tags, such as <P>")  # tags can't overlap, so an inserted one is always found
    source, names = _with_positions(docs, {"key": doc_id, "body": text})
    kinds = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]

    def work(batch, at):
        raw = batch["body"][at]
        raw = raw.as_buffer().to_pybytes() if raw.is_valid else b""
        return moved(raw, batch["key"][at].as_py() or "", seed, rate, spm_rate, sentinels), len(raw)

    schema = StructType([*source.schema.fields[:len(names)], *StructType.fromDDL("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").fields])
    out = source.mapInArrow(lambda batches: _handed(batches, work, kinds), schema)
    return out.toDF(*names, "n", "form", "prefix_chars", "middle_chars", "output")


def restored(rows: DataFrame, output: str = "output", form: str = "form", into: str = "restored", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """All columns, then the text rebuilt from output and form; a null output or form gives null."""
    source, names = _with_positions(rows, {"made": output, "kind": form})

    def work(batch, at):
        raw, kind = batch["made"][at], batch["kind"][at].as_py()
        if not raw.is_valid or kind is None:
            return (None,), 0
        raw = raw.as_buffer().to_pybytes()
        return (moved_back(raw, kind, sentinels),), len(raw)

    schema = StructType([*source.schema.fields[:len(names)], *StructType.fromDDL("restored string").fields])
    return source.mapInArrow(lambda batches: _handed(batches, work, [("restored", pa.binary())]), schema).toDF(*names, into)
