"""Questions of text chunks to shards of a corpus-wide table, and the answers back.

A chunk is a group of texts of bounded bytes. Each chunk sums up what it has and asks every shard once, in one binary record; a shard sees
the records of all chunks, works out what only the whole corpus can tell, and answers each record in the order of its entries. The chunk
lays the answers side by side and finishes its texts. One text shuffle serves asking and finishing; nothing meets in one place but the
records of one shard, whose number grows with the corpus.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

CHUNK_BYTES = 6 << 20
RECORD = "chunk int, shard int, payload binary"


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Bytes of text and number of rows."""
    row = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).head()
    return int(row["b"]), int(row["n"])


def chunk_count(n_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(1, -(-n_bytes // chunk_bytes))


def _hashable(kind: str) -> bool:
    return "map<" not in kind and "variant" not in kind


def with_chunks(docs: DataFrame, doc_id: str, text: str, chunks: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``chunk``, ``text``, and every other column as c0, c1, ... so that no name can clash.

    The chunk follows from id and text, so rows that share an id, or have none, are spread. Rows equal in all columns that together pass a chunk's
    bytes are counted and dealt out again, so many to a chunk; as they are equal, a retry gives the same chunks.
    """
    names = docs.columns
    flat = docs.toDF(*(f"x{i}" for i in range(len(names))))
    at_id, at_text = f"x{names.index(doc_id)}", f"x{names.index(text)}"
    rest = [i for i, name in enumerate(names) if i != names.index(text)]
    shape = [F.col(at_text).cast("string").alias("text"), *(F.col(f"x{i}").alias(f"c{k}") for k, i in enumerate(rest))]
    chunk = lambda *key: F.pmod(F.xxhash64(*key), F.lit(chunks)).cast("int").alias("chunk")
    by_text = chunk(F.col(at_id), F.col(at_text))
    if chunks == 1 or not all(_hashable(f.dataType.simpleString()) for f in docs.schema.fields):
        return flat.select(by_text, *shape)
    keyed = flat.withColumns({"k1": F.xxhash64(*flat.columns), "k2": F.xxhash64(F.lit(1), *flat.columns), "b": F.coalesce(F.octet_length(F.col(at_text).cast("string")), F.lit(0)) + 64})
    most = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("b").cast("long").alias("b")).where(F.col("n") * F.col("b") > chunk_bytes)
    hot = most.where("n > 1").select("k1", "k2", "n", "b").collect()  # fewer than there are chunks of text and row heads
    if not hot:
        return flat.select(by_text, *shape)
    heavy = F.broadcast(docs.sparkSession.createDataFrame(hot, "k1 long, k2 long, n long, per long"))
    light = keyed.join(heavy, ["k1", "k2"], "left_anti").select(by_text, *shape)
    one = keyed.join(heavy, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first(F.struct(*flat.columns)).alias("x"), F.first("n").alias("n"), F.first("per").alias("per"))
    dealt = one.select("k1", "per", "x.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return light.unionAll(dealt.select(chunk(F.col("k1"), F.floor(F.col("i") * F.col("per") / chunk_bytes)), *shape))


def others(docs: DataFrame, text: str) -> list[str]:
    """The names behind c0, c1, ..."""
    names = docs.columns
    return [name for i, name in enumerate(names) if i != names.index(text)]


def carried(chunked: DataFrame) -> list[StructField]:
    return [f for f in chunked.schema.fields if f.name not in ("chunk", "text")]


def ask_and_finish(chunked: DataFrame, ask, answer, finish, added: str) -> DataFrame:
    """``ask(table)`` and ``answer(table)`` give RECORD tables; ``finish(texts, answers)`` gives the columns c0, c1, ... and those of ``added``."""
    questions = chunked.groupBy("chunk").applyInArrow(ask, RECORD)
    answers = questions.groupBy("shard").applyInArrow(answer, RECORD)
    schema = StructType([*carried(chunked), *StructType.fromDDL(added).fields])
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def records(chunk: int, items: list[tuple[int, bytes]]) -> pa.Table:
    """One RECORD row for each (shard, payload)."""
    return pa.table({
        "chunk": pa.array([chunk] * len(items), pa.int32()), "shard": pa.array([s for s, _ in items], pa.int32()),
        "payload": pa.array([b for _, b in items], pa.binary()),
    })


def replies(asked: pa.Table, payloads: list[bytes]) -> pa.Table:
    """The answers to the records of one shard."""
    return pa.table({"chunk": asked["chunk"], "shard": asked["shard"], "payload": pa.array(payloads, pa.binary())})


def with_columns(texts: pa.Table, added: dict) -> pa.Table:
    """The carried columns and the added ones."""
    kept = [n for n in texts.column_names if n not in ("chunk", "text")]
    return pa.table({**{n: texts[n] for n in kept}, **added})
