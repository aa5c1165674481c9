"""How two tokenizers cut the same texts: groups between common token ends, linked tokens, and how often each pair of ids is linked corpus-wide.

Texts are shuffled by their full text, so each distinct text is tokenized and aligned once; the number of its rows is its weight. Tokens of both sides
are laid over the bytes of the text with a space before it. Where a token of A and one of B end together, a group ends; all tokens of A in a group
are linked to all of B in it. A text's links are kept as its distinct id pairs and how often each stands in it (8 bytes a pair), so nothing of
the size of the links is ever shuffled.

Distinct texts are dealt to chunks by their digest. Each chunk sums its pairs before they are counted, so a pair is one row per chunk however common
it is; a pair's count is the number of rows that hold it, and the best count of an id of A the highest of its pairs. The counts go back to the
chunks that asked, which sum them over each text. Measures join the rows by the 128-bit digest of the text. Digests that more than one in
``SHARES`` rows have (so at most SHARES of them) are broadcast, the others shuffled; no task holds the rows of one text or one pair.

Null and empty texts, and texts that one of the tokenizers doesn't give back byte by byte (a normalised character, say), have no tokens: zeros and an
empty digest column. Special tokens inside texts are plain text. Rows that repeat a text have equal measures, each row counts. Ids may be
null or repeat, and other columns pass through, whatever their names; the added ones come last. Ties at the best count all count. An empty table
gives an empty result. A text of any length is one row of a task: tokens and links of 256 texts, or one long one, are held at a time, links in
blocks of ``BLOCK``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage
from .byte_bpe import ByteBpe, byte_letters
from .exchange import chunk_count, text_bytes
from .words import kept_in_worker

CHUNK_BYTES = 16 << 20
#: Links held at a time.
BLOCK = 2_000_000
#: Texts aligned together, and their bytes.
TEXTS, TEXT_BYTES = 256, 2 << 20
#: Words that a task remembers.
KEPT_WORDS = 300_000
SHARES = 10_000
MEASURES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
ALIGNED = "k1 bigint, k2 bigint, copies bigint, chunk int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"


class Side:
    """The bytes of one vocabulary's tokens, and an encoder."""

    def __init__(self, tokens: list[bytes], encode):
        self.size, self.encode = len(tokens), encode
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.lengths = np.diff(self.offsets)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens one after another."""
        size = self.lengths[ids]
        stops = np.cumsum(size)
        return self.blob[np.repeat(self.offsets[ids] - (stops - size), size) + np.arange(int(stops[-1]) if len(stops) else 0)]


class LibraryBpe(ByteBpe):
    """``ByteBpe`` whose new pieces go through the library's own merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        self.letters = {b: letter for letter, b in byte_letters().items()}

    def encode_piece(self, raw: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]


def byte_side(path: str) -> Side:
    """Tokens of a byte-level vocabulary file; encodes the text with a space before it, special tokens as plain text."""
    bpe = LibraryBpe(path)
    return Side([bpe.tokens.get(i, b"") for i in range(bpe.size)], lambda texts: [np.frombuffer(bpe._plain(" " + t), "<u4").astype(np.int64) for t in texts])


class WordPieces:
    """Ids of texts by a sentencepiece model, word by word where that is the same.

    If no piece has the mark of a space behind another character, no merge crosses the place before a space, so words between single blanks are cut
    independently. Distinct words are encoded once and kept, up to ``KEPT_WORDS``; other texts go to the model whole.
    """

    def __init__(self, model):
        self.model, self.known = model, {}
        self.by_word = not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        simple = [self.by_word and t[:1] != " " and t[-1:] != " " and "  " not in t and "▁" not in t for t in texts]
        words = [t.split(" ") if s else [] for t, s in zip(texts, simple)]
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        new = list({w for ws in words for w in ws if w not in known})
        known.update(zip(new, [np.array(x, "<u4").tobytes() for x in self.model.encode(new, num_threads=1)] if new else []))
        whole = iter(self.model.encode([t for t, s in zip(texts, simple) if not s], num_threads=1))
        return [np.frombuffer(b"".join([known[w] for w in ws]), "<u4").astype(np.int64) if s else np.array(next(whole), np.int64) for ws, s in zip(words, simple)]


def piece_side(path: str) -> Side:
    """Tokens of a sentencepiece model, which puts a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Side(tokens, WordPieces(model))


class Pair:
    """Both sides, and the parts of a text's group line for each id."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_side(path_a), piece_side(path_b)
        size_a, size_b = self.a.size, self.b.size
        #: Rows of strings: ids of A before a comma, before a bar, ids of B before a comma, before a semicolon.
        self.parts = [
            *(f"{i}," for i in range(size_a)), *(f"{i}|" for i in range(size_a)), *(f"{i}," for i in range(size_b)), *(f"{i};" for i in range(size_b))]

    def group_lines(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, per_a: np.ndarray, per_b: np.ndarray) -> list[str]:
        """``a1,a2|b1;`` as parts in order for all texts together."""
        size_a, size_b = self.a.size, self.b.size
        out = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.cumsum(per_a) - 1, np.cumsum(per_b) - 1
        kind_a, kind_b = a.copy(), b + 2 * size_a
        kind_a[last_a] += size_a
        kind_b[last_b] += size_b
        out[np.arange(len(a)) + (last_b + 1 - per_b)[group_a]] = kind_a
        out[np.arange(len(b)) + (last_a + 1)[group_b]] = kind_b
        parts = self.parts
        return [parts[i] for i in out.tolist()]


def both_equal(side: Side, ids: list[np.ndarray], wanted: list[bytes]) -> np.ndarray:
    """Whether each text's tokens join to the wanted bytes."""
    lengths = np.array([int(side.lengths[x].sum()) for x in ids], np.int64)
    same = lengths == np.array([len(w) for w in wanted], np.int64)
    at = np.flatnonzero(same)
    if not len(at):
        return same
    made = side.bytes_of(np.concatenate([ids[i] for i in at]))
    differs = np.flatnonzero(made != np.frombuffer(b"".join([wanted[i] for i in at]), np.uint8))
    same[at[np.searchsorted(np.cumsum(lengths[at]), differs, "right")]] = False
    return same


def summed(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their amounts."""
    if not len(keys):
        return keys, amounts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(amounts[order], first)


def linked_pairs(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, per_b: np.ndarray, text_a: np.ndarray, size_b: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, id of A, id of B) as one number, and how many links each has. Links are made ``BLOCK`` at a time."""
    rep = per_b[group_a]
    first_b = (np.cumsum(per_b) - per_b)[group_a]
    stops = np.cumsum(rep)
    found, low = [], 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(stops, (stops[low - 1] if low else 0) + BLOCK, "right")))
        part = rep[low:high]
        before = np.cumsum(part) - part
        other = b[np.repeat(first_b[low:high] - before, part) + np.arange(int(part.sum()))]
        keys = np.repeat(text_a[low:high] * span + a[low:high] * size_b, part) + other
        found.append(summed(keys, np.ones(len(keys), np.int64)))
        if len(found) > 8:
            found = [summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))]
        low = high
    return summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def aligned_texts(pair: Pair, texts: list[str]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, groups_sha256 and the packed links of each text."""
    a_all, b_all = pair.a.encode(texts), pair.b.encode(texts)
    wanted = [b" " + t.encode() for t in texts]
    good = both_equal(pair.a, a_all, wanted) & both_equal(pair.b, b_all, wanted)
    at = np.flatnonzero(good)
    out: list[tuple] = [(0, 0, 0, 0, "", b"")] * len(texts)
    if not len(at):
        return out
    n_a, n_b = np.array([len(a_all[i]) for i in at]), np.array([len(b_all[i]) for i in at])
    a, b = np.concatenate([a_all[i] for i in at]), np.concatenate([b_all[i] for i in at])
    end_a, end_b = np.cumsum(pair.a.lengths[a]), np.cumsum(pair.b.lengths[b])
    ends = np.intersect1d(end_a, end_b, assume_unique=True)  # the ends of texts are among them
    group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
    per_a, per_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
    stop_group = group_a[stop_a - 1] + 1
    links = np.concatenate([[0], np.cumsum(per_a * per_b)])
    n_groups, n_links = np.diff(stop_group, prepend=0), np.diff(links[stop_group], prepend=0)
    lines = pair.group_lines(a, b, group_a, group_b, per_a, per_b)
    span = pair.a.size * pair.b.size
    keys, times = linked_pairs(a, b, group_a, per_b, np.repeat(np.arange(len(at)), n_a), pair.b.size, span)
    cuts = np.searchsorted(keys, np.arange(len(at) + 1) * span)
    kind = "<u4" if span <= 1 << 32 else "<u8"
    for k, i in enumerate(at.tolist()):
        low, high = int(stop_a[k] + stop_b[k] - n_a[k] - n_b[k]), int(stop_a[k] + stop_b[k])
        digest = hashlib.sha256("".join(lines[low:high])[:-1].encode()).hexdigest()
        c, d = int(cuts[k]), int(cuts[k + 1])
        packed = (keys[c:d] - k * span).astype(kind).tobytes() + times[c:d].astype(kind).tobytes()
        out[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), digest, packed)
    return out


def unpacked(links: pa.ChunkedArray | pa.Array, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and times of all texts, and the places where each text's begin and the last ends."""
    kind = np.dtype("<u4" if span <= 1 << 32 else "<u8")
    parts = [np.frombuffer(x.as_buffer(), kind) for x in links]
    cuts = np.concatenate([[0], np.cumsum([len(p) // 2 for p in parts])]).astype(np.int64)
    empty = np.zeros(0, kind)
    return np.concatenate([empty, *(p[:len(p) // 2] for p in parts)]).astype(np.int64), np.concatenate([empty, *(p[len(p) // 2:] for p in parts)]).astype(np.int64), cuts


def sums_between(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[cuts])


def aligned(texts: DataFrame, path_a: str, path_b: str, chunks: int) -> DataFrame:
    """``ALIGNED`` for each row of ``texts``: text, copies."""
    keyed = texts.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "copies", "text")
    keyed = keyed.select("k1", "k2", "copies", F.pmod("k1", F.lit(chunks)).cast("int").alias("chunk"), "text")
    names = [f.split()[0] for f in ALIGNED.split(", ")]

    def run(batches):
        pair = kept_in_worker(("token_links", path_a, path_b), lambda: Pair(path_a, path_b))
        for batch in batches:
            low, size = 0, 0
            for at in range(batch.num_rows):
                size += len(batch["text"][at].as_buffer())
                if at + 1 - low == TEXTS or size >= TEXT_BYTES or at + 1 == batch.num_rows:
                    part = batch.slice(low, at + 1 - low)
                    rows = aligned_texts(pair, part["text"].to_pylist())
                    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [*(part[c] for c in ("k1", "k2", "copies", "chunk")), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)
                    low, size = at + 1, 0

    return keyed.mapInArrow(run, ALIGNED)


def pair_counts(asked: DataFrame, size_b: int) -> DataFrame:
    """key, n and best: the number of rows that hold a linked pair, and whether no pair of its id of A has a higher one. ``asked``: key, n."""
    counts = asked.groupBy("key").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"key div {size_b}"))
    top = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("top")))  # at most one row for each id of A
    return counts.join(top, "a").select("key", "n", (F.col("n") == F.col("top")).alias("best"))


def text_measures(texts: DataFrame, path_a: str, path_b: str, chunks: int) -> DataFrame:
    """k1, k2, copies and the measures of each row of ``texts``: text, copies."""
    side_a, side_b = ByteBpe(path_a).size, piece_side(path_b).size
    span = side_a * side_b
    spread = aligned(texts, path_a, path_b, chunks).repartition(chunks, "chunk")  # one shuffle serves asking and finishing

    def ask(table: pa.Table) -> pa.Table:
        keys, _, cuts = unpacked(table["links"], span)
        found, n = summed(keys, np.repeat(table["copies"].to_numpy(), np.diff(cuts)))
        return pa.table({"chunk": pa.array(np.full(len(found), table["chunk"][0].as_py()), pa.int32()), "key": found, "n": n})

    asked = spread.groupBy("chunk").applyInArrow(ask, "chunk int, key bigint, n bigint")
    answers = asked.select("chunk", "key").join(pair_counts(asked.select("key", "n"), side_b), "key").select("chunk", "key", "n", "best")

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        keys, times, cuts = unpacked(rows["links"], span)
        known = told["key"].to_numpy()
        order = np.argsort(known)
        place = order[np.searchsorted(known[order], keys)] if len(known) else np.zeros(0, np.int64)
        n, best = told["n"].to_numpy(), told["best"].to_numpy(zero_copy_only=False)
        added = {"n_best": sums_between(times * best[place], cuts), "count_sum": sums_between(times * n[place], cuts)}
        return pa.table({**{c: rows[c] for c in ("k1", "k2", "copies", "n_a", "n_b", "n_groups", "n_links")}, **added, "groups_sha256": rows["groups_sha256"]})

    return spread.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"k1 bigint, k2 bigint, copies bigint, {MEASURES}")


def measured(docs: DataFrame, path_a: str, path_b: str, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All columns of ``docs`` but the text, then the columns of ``MEASURES``.

    ``path_a`` is a byte-level vocabulary file, ``path_b`` a sentencepiece model; both are read where the tasks run.
    """
    names = docs.columns
    rest = [f"x{i}" for i, name in enumerate(names) if i != names.index(text)]
    flat = docs.toDF(*(f"x{i}" for i in range(len(names)))).withColumn("text", F.col(f"x{names.index(text)}").cast("string"))
    n_bytes, n_rows = text_bytes(flat.select("text"))
    held = (F.col("text") != "") & F.col("text").isNotNull()
    distinct = flat.where(held).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    found = cut_lineage(text_measures(distinct, path_a, path_b, chunk_count(n_bytes, chunk_bytes)))
    often = found.where(F.col("copies") > max(1000, n_rows // SHARES))
    measures = [f.split()[0] for f in MEASURES.split(", ")]
    keyed = flat.where(held).select(*rest, F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    hot = F.broadcast(often.drop("copies"))
    rare = keyed.join(F.broadcast(often.select("k1", "k2")), ["k1", "k2"], "left_anti")
    many = rare.join(found.where(F.col("copies") <= max(1000, n_rows // SHARES)).drop("copies"), ["k1", "k2"])
    none = flat.where(~F.coalesce(held, F.lit(False))).select(*rest, *(F.lit("" if m == "groups_sha256" else 0).cast("string" if m == "groups_sha256" else "bigint").alias(m) for m in measures))
    out = keyed.join(hot, ["k1", "k2"]).select(*rest, *measures).unionAll(many.select(*rest, *measures)).unionAll(none)
    return out.toDF(*(name for i, name in enumerate(names) if i != names.index(text)), *measures)
