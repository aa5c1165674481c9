"""Token-ID output: Parquet files with one row per text, its ids as a list column, and the place of the ids in the file.

Texts are dealt to files by ranges of the id and written in ascending order, so that the concatenation of the files is the training stream.
Columns: ``doc_id``, ``part`` (the file's number), ``begin`` (ids of the file before this text), ``n_tokens`` and ``tokens``. Ids of tokens are
dictionary-encoded, the ascending columns delta-encoded (format version 2); row groups and pages have set sizes, and the page indexes let a
reader fetch the ids of a range of texts, or the lengths alone, without the rest of the file.

Texts are cut at ASCII white space and where an ASCII letter meets an ASCII mark other than an apostrophe. The library's normalizers and its
split pattern never look across these borders, so distinct words are encoded once with the tokenizers library, remembered, and put together.
Words of one batch are told apart by 64-bit hashes.

Null and empty texts have only the end id. Null ids come first; repeated ids are rows of their own, in order of their text. An empty table
gives files without rows. Extra columns are not written.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .exchange import text_bytes
from .words import flat, kept_in_worker, words_of

#: Bytes of text for one file.
FILE_BYTES = 32 << 20
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Words that a task remembers.
KEPT_WORDS = 500_000
#: New words of letters that the library gets as one text.
JOINED_WORDS = 200

#: Bytes of ASCII letters are kind 1, ASCII marks kind 2; an apostrophe may belong to an ending, so it is neither, as digits and other letters are.
KINDS = np.array([1 if chr(b).isalpha() and b < 128 else 2 if 33 <= b < 127 and not chr(b).isalnum() and b != 39 else 0 for b in range(256)], np.uint8)


class WordEncoder:
    """Packed little-endian ids of texts by words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that end a piece.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _each(self, words: list[bytes]) -> None:
        for word, got in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
            self.known[word] = np.array(got.ids, "<u4").tobytes()

    def _ask(self, words: list[bytes]) -> None:
        """Words of letters have one piece each, so that the ids of many fall apart at the tokens that end a piece; where they don't, one by one."""
        simple, other = [], []
        for w in words:
            (simple if w.isalpha() or w.decode().isalpha() else other).append(w)
        self._each(other)
        groups = [simple[k:k + JOINED_WORDS] for k in range(0, len(simple), JOINED_WORDS)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):
                self._each(group)
                continue
            packed, stops = ids.tobytes(), (4 * stops).tolist()
            self.known.update(zip(group, [packed[begin:stop] for begin, stop in zip([0, *stops], stops)]))

    def encode(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """Packed ids of each text, then ``end``. Distinct words are looked up once for all texts; ids are gathered by place."""
        texts = texts.cast(pa.large_string()).fill_null("")
        # added tokens are found before letters are lower-cased: texts that may hold one go to the library as they are
        whole = pc.match_substring(texts, "<|")
        plain = pc.if_else(whole, "", texts)
        raw, offs = flat(plain)
        raw = raw.copy()
        raw[(raw >= 65) & (raw <= 90)] |= 0x20
        words = words_of(raw, offs, kinds=KINDS)
        _, at, own = np.unique(words.hashes, return_index=True, return_inverse=True)
        data = raw.tobytes()
        distinct = [data[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]
        known = self.known
        self._ask([w for w in distinct if w not in known])
        packed = [known[w] for w in distinct]
        if len(known) > KEPT_WORDS:  # the words of these texts stay: the common ones are among them
            self.known = dict(zip(distinct, packed))
        size = np.array([len(p) // 4 for p in packed], np.int64)
        begin = np.cumsum(size) - size
        size, begin = size[own], begin[own]
        stops = np.concatenate([[0], np.cumsum(size)])
        values = np.frombuffer(b"".join(packed), "<u4")[np.repeat(begin - stops[:-1], size) + np.arange(stops[-1])].tobytes()
        cuts = (4 * stops[words.first]).tolist()
        out = [values[a:b] + end for a, b in zip(cuts[:-1], cuts[1:])]
        special = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        for i, got in zip(special, self.tokenizer.encode_batch_fast([texts[i].as_py() for i in special], add_special_tokens=False)):
            out[i] = np.array(got.ids, "<u4").tobytes() + end
        return out


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> int:
    """Encode every text, append ``end_id`` and write the files under ``path``; the number of files at most."""
    n_bytes, _ = text_bytes(docs, text)
    files = max(1, -(-n_bytes // file_bytes))
    id_type = docs.schema[doc_id].dataType.simpleString()
    dealt = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = kept_in_worker(("word_encoder", vocabulary), lambda: WordEncoder(vocabulary))
        part, begin = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                piece = batch.slice(low, 512)
                ids = encoder.encode(piece["text"], end)
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                stops = np.concatenate([[0], np.cumsum(sizes)])
                values = np.frombuffer(b"".join(ids), "<i4")
                yield pa.RecordBatch.from_arrays([
                    piece["doc_id"], pa.array(np.full(len(sizes), part, np.int32)), pa.array(begin + stops[:-1]), pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(values)),
                ], ["doc_id", "part", "begin", "n_tokens", "tokens"])
                begin += int(stops[-1])

    coded = dealt.mapInArrow(run, StructType.fromDDL(f"doc_id {id_type}, part int, begin bigint, n_tokens bigint, tokens array<int>"))
    writer = coded.write.option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
    for column in ("doc_id", "begin", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.mode("errorifexists").option("maxRecordsPerFile", 0).parquet(path)
    return files


def stream_places(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, begin, n_tokens and ``start``: ids of all texts before. Reads no token pages; one total per file is summed in one task."""
    rows = spark.read.parquet(path).select("doc_id", "part", "begin", "n_tokens")
    return rows.join(F.broadcast(file_starts(spark, path)), "part").withColumn("start", F.col("before") + F.col("begin")).drop("before")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, all from the files."""
    rows = spark.read.parquet(path)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                piece = batch.slice(low, 256)
                lists = piece["tokens"]
                stops = (4 * (lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py())).tolist()
                values = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(), "<i4")).cast("B")
                crc = [zlib.crc32(values[a:b]) for a, b in zip(stops[:-1], stops[1:])]
                yield pa.RecordBatch.from_arrays([*(piece[c] for c in ("doc_id", "part", "begin", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "part", "begin", "n_tokens", "ids_crc32"])

    sums = rows.select("doc_id", "part", "begin", "n_tokens", "tokens").mapInArrow(run, f"doc_id {id_type}, part int, begin bigint, n_tokens bigint, ids_crc32 bigint")
    return sums.join(F.broadcast(file_starts(spark, path)), "part").select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str, low, high) -> DataFrame:
    """Ids of the texts with low <= doc_id <= high; the range reaches the scan, whose page indexes skip the rest."""
    return spark.read.parquet(path).where(F.col("doc_id").between(low, high)).select("doc_id", "tokens")
