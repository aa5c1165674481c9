"""From raw documents to token ids: quality rules, near copies, repeated passages, benchmark leaks, byte-level BPE.

Every stage reads what the one before it kept and wrote. All but the last return the columns of ``documents``, with n_chars as the text now is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers
from sparktab.llm import byte_bpe, line_rules, minhash_forest, template_leaks, windows
from sparktab.session import scratch_path


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail the base rules or lose too much."""
    return _counted(line_rules.clean(docs, "text"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return minhash_forest.keep_one(docs, "doc_id", "text")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that stand elsewhere too are cut out."""
    return _counted(windows.remove_repeats(docs, "doc_id", "text"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go."""
    return template_leaks.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id", "text")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the decoded text."""
    coded = byte_bpe.coded(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), "text")
    return coded.select(
        "doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination), ("bpe_encoding", bpe_encoding),
]
#: SQL can't express the line rules, the join or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
