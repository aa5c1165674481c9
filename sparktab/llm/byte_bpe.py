"""BPE encoding and decoding with a byte-level vocabulary file of the tokenizers library, without its merge loop.

The encoder walks a piece from left to right, takes the longest token that an Aho-Corasick automaton finds at each place, and keeps it only if
the pair with the token before it is compatible: no merge that BPE would have made earlier crosses the border between the two. Otherwise it
tries the next shorter token, and goes back one token when none is left; places found impossible are marked and never entered again, so each
place is left at most once and the work is linear. The result is exactly that of the merges in order of rank. Pair checks are kept in a
table. Decoding cuts the tokens' bytes out of one blob by an offset table.

Text is split first at the strings of the added tokens, then by the byte-level pattern. Distinct pieces are encoded once per task and kept in
a table of bounded size. Null and empty texts give no ids and the empty text. The operator works row by row: repeated rows, ties and extra
columns need no care.
"""

from __future__ import annotations

import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .words import kept_in_worker

# The library's split pattern, and the code points that are letters or numbers only in Unicode versions its patterns don't know.
LATER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    r"\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    r"\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    r"\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    r"\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def split_pattern(letter: str, number: str, space: str) -> str:
    """The split pattern for given insides of the three character classes."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


#: Latin-1 texts need no Unicode tables.
LATIN = re.compile(split_pattern("A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"))


#: Pieces that a task remembers.
KEPT_PIECES = 300_000
#: Pair checks that a task remembers.
KEPT_PAIRS = 500_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Vocabulary tables of one file; the path is a parameter and the file stays where it is."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        model = data["model"]
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        by_bytes = {t: i for i, t in self.tokens.items()}
        self.by_bytes = by_bytes
        #: (left, right) -> rank and merged id, and the two parts of each merged id
        self.merges: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (bytes(letters[c] for c in x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            pair, whole = (by_bytes[left], by_bytes[right]), by_bytes[left + right]
            if pair not in self.merges:
                self.merges[pair] = rank
                if whole not in self.parts:
                    self.rank[whole], self.parts[whole] = rank, pair
        self.pair_whole = {pair: by_bytes[self.tokens[pair[0]] + self.tokens[pair[1]]] for pair in self.merges}
        self.size = max([*self.tokens, *self.added.values()]) + 1
        everything = [self.tokens.get(i, b"") for i in range(self.size)]
        for content, i in self.added.items():
            everything[i] = content.encode()
        self.blob = np.frombuffer(b"".join(everything), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in everything])])
        self.length = {i: len(t) for i, t in self.tokens.items()}
        self.split = regex.compile(split_pattern(r"\p{L}", r"\p{N}", r"\p{White_Space}"))
        self.later = regex.compile(f"[{LATER}]")
        self.split_later = regex.compile("(?V1)" + split_pattern(rf"[\p{{L}}--[{LATER}]]", rf"[\p{{N}}--[{LATER}]]", r"\p{White_Space}"))
        self.at_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        #: Tokens that BPE makes of their own bytes; others never appear.
        self.real = {i for i, t in self.tokens.items() if len(t) == 1}
        for i in sorted(self.rank, key=self.rank.get):
            left, right = self.parts[i]
            if left in self.real and right in self.real and self._borders(left, right, self.rank[i]):
                self.real.add(i)
        #: The longest shorter token that a token begins with; -1 for single bytes.
        self.shorter = [-1] * self.size
        self.automaton = ahocorasick.Automaton()
        for i in self.real:
            token = self.tokens[i]
            self.automaton.add_word(token.decode("latin-1"), (i, len(token) - 1))
            self.shorter[i] = next((by_bytes[token[:k]] for k in range(len(token) - 1, 0, -1) if by_bytes.get(token[:k]) in self.real), -1)
        self.automaton.make_automaton()

    def _borders(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge of a rank below ``limit`` crosses the border when BPE runs on the bytes of both tokens."""
        merges, rank, parts = self.merges, self.rank, self.parts
        end = limit
        while True:
            crossing = merges.get((left, right))
            if crossing is not None and crossing < end:
                return False
            # undo the later of the two last merges beside the border
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # merges of one rank run from the left: a crossing one would come after this
                end, left = a, parts[left][1]
            else:  # and before this
                end, right = b + 1, parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._borders(left, right, 1 << 60)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.by_bytes.get(piece)
        if whole is not None and whole in self.real:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (i, back) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = i  # at one place, longer tokens end later
        length, shorter, pairs, size = self.length, self.shorter, self.pairs, self.size
        out, possible, place, token = [], [True] * (n + 1), 0, longest[0]
        while True:
            if token >= 0:
                to = place + length[token]
                if possible[to]:
                    if out:
                        fits = pairs.get(out[-1] * size + token)
                        if fits is None:
                            fits = self.compatible(out[-1], token)
                    else:
                        fits = True
                    if fits:
                        out.append(token)
                        if to == n:
                            return out
                        place, token = to, longest[to]
                        continue
                token = shorter[token]
            else:
                possible[place] = False
                last = out.pop()
                place -= length[last]
                token = shorter[last]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if self.at_added is not None and any(t in text for t in self.added):
            return b"".join(self.added[part].to_bytes(4, "little") if part in self.added else self._plain(part) for part in self.at_added.split(text) if part)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            pieces = LATIN.findall(text)
        except UnicodeEncodeError:
            pieces = (self.split_later if self.later.search(text) else self.split).findall(text)
        kept = self.pieces
        if len(kept) > KEPT_PIECES:
            kept.clear()
        try:
            return b"".join([kept[p] for p in pieces])
        except KeyError:
            for p in pieces:
                if p not in kept:
                    kept[p] = np.array(self.encode_piece(p.encode()), "<u4").tobytes()
            return b"".join([kept[p] for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids."""
        number = np.frombuffer(ids, "<u4").astype(np.int64)
        begin = self.offsets[number]
        size = self.offsets[number + 1] - begin
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.blob[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])].tobytes()


def coded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, then ``ids`` (packed little-endian unsigned 32-bit) and ``decoded`` (text)."""
    names = docs.columns
    at = names.index(text)
    rest = [i for i in range(len(names)) if i != at]
    source = docs.toDF(*(f"x{i}" for i in range(len(names)))).select(*(F.col(f"x{i}").alias(f"c{k}") for k, i in enumerate(rest)), F.col(f"x{at}").cast("string").alias("text"))
    schema = StructType([*source.schema.fields[:-1], *StructType.fromDDL("ids binary, decoded string").fields])

    def run(batches):
        bpe = kept_in_worker(("byte_bpe", path), lambda: ByteBpe(path))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = [bpe.encode(t or "") for t in part["text"].to_pylist()]
                decoded = [bpe.decode(x).decode("utf-8", "replace") for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [*part.schema.names[:-1], "ids", "decoded"])

    return source.mapInArrow(run, schema).toDF(*(names[i] for i in rest), "ids", "decoded")
