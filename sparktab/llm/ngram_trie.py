"""LM scoring with Elias-Fano n-gram tries.

The model is a bigram model with a Dirichlet prior on the unigrams: p(w | v) = (c(v w) + m p(w)) / (c(v) + m). Unigrams give unknown words
together the Good-Turing mass u = (n1 + 1) / (N + 2), n1 being the tokens seen once, and known words (1 - u) (c + 1) / (N + V). A text begins
after a start mark and ends with an end token; both models count that token.

The n-grams of the corpus are cut into shards by context. A shard is one trie: level 1 has the contexts with exact totals and Elias-Fano
pointers, level 2 the successors of each context, as ranks made monotone over the contexts, with the quantised logarithms of c(v w) /
(c(v) + m) beside them. The file is memory-mapped and searched by successor queries relative to the end of the previous context. Contexts
with more tokens than a shard takes are spread over several shards by their successor; their totals, at most one for each half shard, are
known to every task.

A chunk of texts asks the shards for its distinct bigrams and scores its texts from the answers, that is from the model filtered to what
the chunk can use. Counts of training bigrams travel in the same records, so the corpus is read once more for words only.

Words are 64-bit hashes (see words.py). Null and empty texts have the end token only. A null id is in no held-out part. Repeated rows are
scored, and counted, each for itself. An empty table gives an empty result; a corpus without training rows scores by the unknown-word
mass alone. Extra columns pass through under their names.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exchange import ask_and_finish, chunk_count, others, records, replies, text_bytes, with_chunks, with_columns
from .succinct import EliasFano
from .words import flat, mix, words_of

#: Prior weight m of the unigrams, in tokens.
PRIOR = 4.0
#: Training tokens and questions that one shard takes on average.
SHARD_TOKENS = 1_000_000
#: Steps of a quantised log10 probability; code 0 is "not seen".
STEPS = 4096
START, END = np.uint64(0x5374617274), np.uint64(0x456E64)


def quantise(p: np.ndarray) -> np.ndarray:
    """log10 of probabilities above 10^-15.9 as 1 .. 65535."""
    return np.clip(np.rint(-np.log10(p) * STEPS) + 1, 1, 65535).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((1.0 - code) / STEPS), 0.0)


class Trie:
    """Two memory-mapped levels. ``folder`` holds one file; ``close`` unmaps it and removes the folder."""

    NAMES = ("contexts", "totals", "words", "codes")

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, count: np.ndarray, totals: dict[int, int], prior: float, folder: str | None = None) -> "Trie":
        """From hashes of (context, word) pairs, one of each, with positive counts. ``totals``: exact totals of spread contexts."""
        contexts, own = np.unique(context, return_inverse=True)
        words, rank = np.unique(word, return_inverse=True)
        total = np.bincount(own, weights=count, minlength=len(contexts)).astype(np.int64)
        if totals:
            keys = np.array(sorted(totals), np.uint64)
            at = np.searchsorted(contexts, keys)
            here = at < len(contexts)
            here[here] = contexts[at[here]] == keys[here]
            total[at[here]] = [totals[int(k)] for k in keys[here]]
        order = np.lexsort((rank, own))
        own, rank, count = own[order], rank[order], count[order]
        begins = np.searchsorted(own, np.arange(len(contexts) + 1))
        # a rank is made monotone by what stands at the end of the previous context
        widths = rank[begins[1:] - 1] + 1 if len(contexts) else np.zeros(0, np.int64)
        base = np.concatenate([[0], np.cumsum(widths)])
        successors = EliasFano.build(rank + base[own]) if len(contexts) else EliasFano.build(np.zeros(0, np.int64))
        codes = quantise(count / (total[own] + prior)) if len(contexts) else np.zeros(0, np.uint16)
        parts = [contexts, total, words, codes, *EliasFano.build(begins).arrays(), *successors.arrays()]
        folder = tempfile.mkdtemp(prefix="trie-", dir=folder)
        path = os.path.join(folder, "levels")
        places = []
        with open(path, "wb") as f:
            for part in parts:
                part = np.ascontiguousarray(part)
                places.append((f.tell(), part.dtype, len(part)))
                f.write(part.tobytes() + b"\0" * (-part.nbytes % 8))
            f.write(b"\0" * 8)
        return Trie(folder, path, places)

    def __init__(self, folder: str, path: str, places: list):
        self.folder = folder
        self.file = np.memmap(path, np.uint8, "r")
        parts = [self.file[at:at + kind.itemsize * n].view(kind) for at, kind, n in places]
        self.contexts, self.totals, self.words, self.codes = parts[:4]
        self.pointers, self.successors = EliasFano.of(parts[4:8]), EliasFano.of(parts[8:12])

    def close(self) -> None:
        del self.contexts, self.totals, self.words, self.codes, self.pointers, self.successors, self.file
        shutil.rmtree(self.folder, ignore_errors=True)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted hash, -1 where there is none."""
        if not len(keys):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def find_context(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and total of each context; -1 and 0 for an unseen one."""
        at = self._find(self.contexts, context)
        return at, np.where(at >= 0, self.totals[np.maximum(at, 0)], 0) if len(self.contexts) else np.zeros(len(at), np.int64)

    def find_word(self, word: np.ndarray) -> np.ndarray:
        return self._find(self.words, word)

    def lookup(self, context_at: np.ndarray, word_at: np.ndarray) -> np.ndarray:
        """The code of each (context, word), both as places; 0 where the pair was not seen."""
        out = np.zeros(len(context_at), np.uint16)
        known = np.flatnonzero((context_at >= 0) & (word_at >= 0))
        if len(known):
            contexts, own = np.unique(context_at[known], return_inverse=True)
            begin, end = self.pointers.get(contexts), self.pointers.get(contexts + 1)
            base = np.where(begin > 0, self.successors.get(np.maximum(begin - 1, 0)) + 1, 0)
            target = word_at[known] + base[own]
            place, value = self.successors.successor(target)
            hit = (value == target) & (place < end[own])
            out[known[hit]] = self.codes[place[hit]]
        return out


def training(ids: pa.ChunkedArray | pa.Array, parts: int, held: int) -> np.ndarray:
    """Which ids are held out: crc32 of the id as text modulo ``parts`` is ``held``; null ids are not."""
    return np.array([x is not None and zlib.crc32(str(x).encode()) % parts == held for x in ids.to_pylist()], bool)


def word_counts(docs: DataFrame, doc_id: str, text: str, parts: int, held: int) -> DataFrame:
    """word (hash) and n, its tokens in training texts; the end token is not among them."""
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))

    def count(batches):
        keys, sums, size = [], [], 0

        def merged():
            word, own = np.unique(np.concatenate(keys), return_inverse=True)
            return word, np.bincount(own, weights=np.concatenate(sums)).astype(np.int64)

        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                learn = ~training(part["id"], parts, held)
                words = words_of(*flat(part["text"]), fold=True)
                got, n = np.unique(words.hashes[learn[words.texts()]], return_counts=True)
                keys.append(got)
                sums.append(n)
                size += len(got)
                if size > 2_000_000:  # bounds the memory of a task; Spark adds up what it gives
                    word, n = merged()
                    keys, sums, size = [word], [n], len(word)
                    if size > 1_000_000:
                        yield pa.record_batch({"word": word.view(np.int64), "n": n})
                        keys, sums, size = [], [], 0
        if size:
            word, n = merged()
            yield pa.record_batch({"word": word.view(np.int64), "n": n})

    return source.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 7, held: int = 2, prior: float = PRIOR, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """All columns of ``docs`` but the text, then held_out, n_tokens, n_known, train_tokens, base_score and score."""
    n_bytes, n_rows = text_bytes(docs, text)
    shards = max(1, -(-n_bytes // (6 * shard_tokens)))
    counts = word_counts(docs, doc_id, text, parts, held)
    spread_from = max(2, shard_tokens // 2)
    key = F.col(doc_id).cast("string")
    learn = ~F.coalesce((F.crc32(F.encode(key, "utf-8")) % parts) == held, F.lit(False))
    n_learn = docs.select(learn.alias("l")).where("l").count()
    stats = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)).alias("once"),
        F.collect_list(F.when(F.col("n") >= spread_from, F.struct("word", "n"))).alias("hot"),  # at most 2 for each shard
    ).head()
    hot = {int(r["word"]) & (1 << 64) - 1: int(r["n"]) for r in stats["hot"]}
    if n_learn >= spread_from:
        hot[int(START)] = n_learn
    tokens, kinds = stats["n"] + n_learn, stats["v"] + (n_learn > 0)
    unknown = (stats["once"] + (n_learn == 1) + 1) / (tokens + 2)
    hot_words = np.array(sorted(hot), np.uint64)
    hot_ways = np.array([-(-hot[int(w)] // spread_from) for w in hot_words], np.uint64)
    chunked = with_chunks(docs, doc_id, text, chunk_count(n_bytes))
    at_id = f"c{others(docs, text).index(doc_id)}"

    def look(texts: pa.Table):
        """Distinct bigrams of the chunk in the order of the records: word list, context, word, shard; and each token's bigram."""
        held_out = training(texts[at_id], parts, held)
        raw, offs = flat(texts["text"])
        words = words_of(raw, offs, fold=True)
        lengths = np.diff(words.first) + 1
        first = np.concatenate([[0], np.cumsum(lengths)])
        token = np.full(first[-1], END, np.uint64)
        inner = np.ones(first[-1], bool)
        inner[first[1:] - 1] = False
        token[inner] = words.hashes
        del words, inner, raw
        vocabulary, ids = np.unique(np.concatenate([token, [START, END]]), return_inverse=True)
        del token
        start = ids[-2]
        before = np.empty(first[-1], np.int64)
        before[1:] = ids[:-3]
        before[first[:-1]] = start
        pair, own = np.unique(before * len(vocabulary) + ids[:-2], return_inverse=True)
        left, right = pair // len(vocabulary), pair % len(vocabulary)
        del before, pair
        route = mix(vocabulary)[left] >> np.uint64(20)
        if len(hot_words):
            at = np.minimum(np.searchsorted(hot_words, vocabulary), len(hot_words) - 1)
            ways = np.where(hot_words[at] == vocabulary, hot_ways[at], np.uint64(1))[left]
            route += mix(vocabulary ^ np.uint64(0x5A5A5A5A))[right] % ways
        shard = (route % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        learned = np.bincount(own, weights=np.repeat(~held_out, lengths), minlength=len(left)).astype(np.int64)
        return held_out, first, vocabulary, ids[:-2], left[order], right[order], shard[order], back[own], learned[order]

    def ask(texts: pa.Table) -> pa.Table:
        _, _, vocabulary, _, left, right, shard, _, learned = look(texts)
        ends = np.searchsorted(shard, np.arange(shards + 1))
        out = []
        for s in range(shards):
            low, high = ends[s], ends[s + 1]
            if low < high:
                contexts, sizes = np.unique(left[low:high], return_counts=True)
                words, own = np.unique(right[low:high], return_inverse=True)
                small = np.uint16 if len(words) < 1 << 16 else np.uint32
                body = zlib.compress(sizes.astype(np.uint32).tobytes() + learned[low:high].astype(np.uint32).tobytes() + own.astype(small).tobytes(), 1)
                head = np.array([len(contexts), len(words), high - low], np.int64).tobytes()
                out.append((s, head + vocabulary[contexts].tobytes() + vocabulary[words].tobytes() + body))
        return records(texts["chunk"][0].as_py(), out)

    def opened(payload: bytes):
        n_contexts, n_words, n = np.frombuffer(payload, np.int64, 3)
        contexts = np.frombuffer(payload, np.uint64, n_contexts, 24)
        words = np.frombuffer(payload, np.uint64, n_words, 24 + 8 * n_contexts)
        body = zlib.decompress(payload[24 + 8 * (n_contexts + n_words):])
        sizes = np.frombuffer(body, np.uint32, n_contexts)
        learned = np.frombuffer(body, np.uint32, n, 4 * n_contexts)
        own = np.frombuffer(body, np.uint16 if n_words < 1 << 16 else np.uint32, n, 4 * (n_contexts + n))
        return contexts, words, np.repeat(np.arange(n_contexts), sizes), own, learned

    def answer(asked: pa.Table) -> pa.Table:
        own = [opened(b) for b in asked["payload"].to_pylist()]
        vocabulary = np.unique(np.concatenate([x for c, w, *_ in own for x in (c, w)]))
        pairs, counts = [], []
        for contexts, words, left, right, learned in own:
            seen = learned > 0
            pairs.append(np.searchsorted(vocabulary, contexts)[left[seen]] * len(vocabulary) + np.searchsorted(vocabulary, words)[right[seen]])
            counts.append(learned[seen])
        pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate(counts), minlength=len(pair)).astype(np.int64)
        trie = Trie.build(vocabulary[pair // len(vocabulary)], vocabulary[pair % len(vocabulary)], count, hot, prior)
        del vocabulary, pairs, counts, pair, at, count
        out = []
        try:
            for contexts, words, left, right, _ in own:
                at, totals = trie.find_context(contexts)
                codes = trie.lookup(at[left], trie.find_word(words)[right])
                out.append(zlib.compress(totals.astype(np.int64).tobytes() + codes.tobytes(), 1))
        finally:
            trie.close()
        return replies(asked, out)

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        held_out, first, vocabulary, ids, left, right, shard, own, _ = look(texts)
        ends = np.searchsorted(shard, np.arange(shards + 1))
        count, codes = np.zeros(len(vocabulary), np.int64), np.zeros(len(shard), np.uint16)
        for s, payload in zip(answers["shard"].to_pylist(), answers["payload"].to_pylist()):
            low, high = ends[s], ends[s + 1]
            contexts = np.unique(left[low:high])
            body = zlib.decompress(payload)
            totals = np.frombuffer(body, np.int64, len(contexts))
            count[contexts] = np.maximum(count[contexts], totals)
            codes[low:high] = np.frombuffer(body, np.uint16, high - low, 8 * len(contexts))
        for word, n in hot.items():  # a spread context may be unknown to the shards that were asked
            at = np.searchsorted(vocabulary, np.uint64(word))
            if at < len(vocabulary) and vocabulary[at] == word:
                count[at] = n
        context_total = count.copy()
        count[np.searchsorted(vocabulary, START)] = 0
        count[np.searchsorted(vocabulary, END)] = n_learn
        base = np.log10((count + 1) / (tokens + kinds + 1))
        unigram = np.where(count > 0, (1 - unknown) * (count + 1) / max(tokens + kinds, 1), unknown)
        weight = prior / (context_total[left] + prior)
        pair = np.log10(dequantise(codes) + weight * unigram[right])
        add = lambda x: np.add.reduceat(x, first[:-1])
        return with_columns(texts, {
            "held_out": held_out, "n_tokens": np.diff(first), "n_known": add((count > 0)[ids].astype(np.int64)),
            "train_tokens": np.full(texts.num_rows, tokens, np.int64), "base_score": add(base[ids]), "score": add(pair[own]),
        })

    out = ask_and_finish(chunked, ask, answer, finish, "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.toDF(*others(docs, text), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
