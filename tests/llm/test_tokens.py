"""BPE encoding (4) and token-ID files (8) against the tokenizers library."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

from sparktab.llm import byte_bpe, queries, token_files  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
POOL = ["<|endoftext|>", "<|ENDOFTEXT|>", " ", "  ", "\n", "\t", "A", "É", "é", "中文", "\xa0", " ", "\x1c", "\x85", "'s", "'ll", "'S", "123", "½", "٣", "😀", "The", "ing", "***", "\r\n",
        "Σ", "İ", "̈", "<|", "'", " x's,", "​", "\x00", "\U00018da9", "aaaa"]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(BYTES)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def encoder():
    return token_files.WordEncoder(WORDS)


def numbers(packed):
    return np.frombuffer(packed, "<u4").tolist()


@given(st.lists(st.one_of(st.sampled_from(POOL), st.text(max_size=4)), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_byte_ids_and_decoding_equal_the_library(bpe, byte_library, text):
    ids = byte_library.encode(text, add_special_tokens=False).ids
    packed = bpe.encode(text)
    assert numbers(packed) == ids
    assert bpe.decode(packed).decode("utf-8", "replace") == byte_library.decode(ids, skip_special_tokens=False)


@given(st.text(alphabet="aeinorsthldg", min_size=1, max_size=60))
@settings(max_examples=400, deadline=None)
def test_long_pieces_with_much_to_merge(bpe, byte_library, text):
    assert numbers(bpe.encode(text)) == byte_library.encode(text, add_special_tokens=False).ids


@given(st.lists(st.one_of(st.sampled_from(POOL), st.text(max_size=4)), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_word_ids_equal_the_library(encoder, word_library, text):
    assert numbers(encoder.encode(pa.array([text]), b"")[0]) == word_library.encode(text, add_special_tokens=False).ids


def rows_with_odd_cases(n=80):
    random.seed(7)
    texts = ["".join(random.choice(POOL) + random.choice([" ", ""]) for _ in range(random.randint(0, 30))) for _ in range(n)]
    return [*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "word " * 20_000), (3, texts[3]), (None, "null id")]


def test_coded_keeps_other_columns(spark, byte_library):
    rows = [(i, t, "x") for i, t in rows_with_odd_cases()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.coded(frame, BYTES)
    assert out.columns == ["doc_id", "ids", "ids", "decoded"]
    got = sorted(((r[0], numbers(r[2]), r[3]) for r in out.collect()), key=str)
    assert got == sorted(((i, (ids := byte_library.encode(t or "", add_special_tokens=False).ids), byte_library.decode(ids, skip_special_tokens=False)) for i, t, _ in rows), key=str)
    assert byte_bpe.coded(frame.limit(0), BYTES).count() == 0


def test_files_hold_the_stream_in_order(spark, word_library, tmp_path):
    rows = rows_with_odd_cases()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(frame, path, WORDS, 2, file_bytes=4096)
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_checked(spark, path).collect()))
    start, expected = 0, []
    for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = word_library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((-1 if i is None else i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    assert sorted((r.start for r in token_files.stream_places(spark, path).collect())) == [e[1] for e in expected]
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    assert len(files) > 3
    meta = pq.ParquetFile(files[0]).metadata.row_group(0)
    kinds = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in kinds["n_tokens"].encodings and "RLE_DICTIONARY" in kinds["tokens.list.element"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in (kinds["doc_id"], kinds["n_tokens"]))
    assert [r.doc_id for r in token_files.read_tokens(spark, path, 10, 12).orderBy("doc_id").collect()] == [10, 11, 12]


def test_empty_table_gives_no_rows(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, WORDS, 2)
    assert token_files.read_checked(spark, path).count() == 0


def test_bpe_query(spark, sf, byte_library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op4_bpe_encoding"](spark, sf).collect():
        ids = byte_library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = byte_library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_token_file_query(spark, sf, word_library):
    start = 0
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.QUERIES["op8_token_files"](spark, sf).collect()}
    for i, t in texts:
        ids = word_library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
