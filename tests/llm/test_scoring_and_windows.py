"""n-gram scoring (1) and substring dedup (9) against brute force on tables with nulls, empty texts, ties and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from sparktab.llm import ngram_trie, queries, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_texts(n, seed, vocabulary=60, most=90):
    random.seed(seed)
    words = ["The", "the", "of"] + [f"w{i}" for i in range(vocabulary)] + ["É", "é", "x|y"]
    passage = " ".join(random.choice(words) for _ in range(50))
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, most))) for _ in range(n)]
    texts = [t + ("\n" + passage if i % 3 == 0 else "") for i, t in enumerate(texts)]
    return [*texts, None, "", " \n\t", texts[0], texts[0], "the " * 120, " ".join(f"long{i % 700}" for i in range(30_000))]


def brute_scores(rows, prior):
    unigram, pair, context, tokens = collections.Counter(), collections.Counter(), collections.Counter(), []
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for doc, text in rows:
        own = WORD.findall((text or "").translate(lower)) + [None]
        held = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2
        tokens.append((doc, held, own))
        if not held:
            before = "^"
            for w in own:
                unigram[w] += 1
                pair[before, w] += 1
                context[before] += 1
                before = w
    n, v = sum(unigram.values()), len(unigram)
    unknown = (sum(c == 1 for c in unigram.values()) + 1) / (n + 2)
    out = []
    for doc, held, own in tokens:
        base = sum(math.log10((unigram[w] + 1) / (n + v + 1)) for w in own)
        score, before = 0.0, "^"
        for w in own:
            low = (1 - unknown) * (unigram[w] + 1) / (n + v) if unigram[w] else unknown
            score += math.log10((pair[before, w] + prior * low) / (context[before] + prior))
            before = w
        out.append((doc, held, len(own), sum(unigram[w] > 0 for w in own), n, base, score))
    return out


@pytest.mark.parametrize("shard_tokens", [300, 1_000_000])  # with and without spread contexts
def test_scores_match_brute_force(spark, shard_tokens):
    rows = list(enumerate(make_texts(60, 1))) + [(None, "the of w1"), (3, "the of w1")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = ngram_trie.score(frame, shard_tokens=shard_tokens).toDF("doc_id", "own", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    expected = sorted(brute_scores(rows, ngram_trie.PRIOR), key=str)
    got = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in got), key=str)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert a[6] == pytest.approx(b[6], abs=1e-6 + 2e-4 * b[2])


def test_held_out_score_beats_the_base(spark, sf):
    rows = [r for r in queries.QUERIES["op1_lm_scoring"](spark, sf).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scoring_of_empty_and_untrained_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_trie.score(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = ngram_trie.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).head()
    assert (row.n_known, row.train_tokens, row.n_tokens) == (0, 0, 3) and math.isfinite(row.score) and row.base_score == 0


def brute_windows(texts, size):
    own = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i:i + size]) for w in own for i in range(len(w) - size + 1))
    out = []
    for w in own:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("shard_hashes", [500, 10**7])
def test_removal_matches_brute_force(spark, shard_hashes):
    texts = make_texts(60, 2)
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    out = windows.removal(frame, shard_hashes=shard_hashes)
    assert out.columns == ["doc_id", "n_words", "n_words", "n_removed", "kept"]
    got = {r[0]: (r[2], r[3], r[4]) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute_windows(texts, windows.WINDOW)


def test_remove_repeats_keeps_columns_and_untouched_texts(spark):
    texts = ["a  b\n c", None, "", *[" ".join(f"q{k}" for k in range(40))] * 2]
    frame = spark.createDataFrame([(None if i == 0 else i, "z", t, i) for i, t in enumerate(texts)], "doc_id long, chunk string, text string, shard int")
    got = {r.shard: r for r in windows.remove_repeats(frame).collect()}
    assert [got[i].text for i in range(5)] == ["a  b\n c", None, "", "", ""] and got[0].doc_id is None and got[4].chunk == "z"
    assert windows.remove_repeats(frame.limit(0)).columns == frame.columns


def test_what_stays_keeps_its_lines(spark):
    passage = " ".join(f"p{k}" for k in range(50))
    texts = [f"one\n two  three\n{passage}\nfour\tfive\n", f"{passage} six", f"seven {passage}", f"{passage}\neight\n{passage}"]
    got = {r.doc_id: r.text for r in windows.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "one\n two  three\nfour\tfive", 1: "six", 2: "seven", 3: "eight"}


def test_window_query_over_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expected = dict(zip(texts, brute_windows(texts.values(), 35)))
    for r in queries.QUERIES["op9_substring_dedup"](spark, sf).collect():
        n, removed, kept = expected[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())


def test_chunks_stay_bounded_for_null_ids_and_equal_rows(spark):
    from sparktab.llm.exchange import with_chunks

    texts = [f"text {i} " + "word " * 200 for i in range(300)] + ["the same " * 100] * 300
    frame = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    chunked = with_chunks(frame, "doc_id", "text", 20, 30_000)
    got = [tuple(r) for r in chunked.select("chunk", "text", "c0").collect()]
    assert sorted(t for _, t, _ in got) == sorted(texts) and all(i is None for _, _, i in got)
    sizes = {}
    for c, t, _ in got:
        sizes[c] = sizes.get(c, 0) + len(t)
    assert len(sizes) > 10 and max(sizes.values()) < sum(map(len, texts)) / 4
    again = with_chunks(frame.repartition(7), "doc_id", "text", 20, 30_000)
    assert sorted(x[:2] for x in got) == sorted(tuple(r) for r in again.select("chunk", "text").collect())
