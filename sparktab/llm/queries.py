"""The registered queries of the operators: production parameters, whole tables, digest columns as the contracts name them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import (
    byte_bpe, chat_events, html_cut, licence_rules, line_rules, middle_blocks, minhash_forest, ngram_trie, oracles, template_leaks, token_files, token_links, warc_files,
    windows,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_substring_dedup", oracles.SUBSTRING_DEDUP)
def substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return windows.removal(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op1_lm_scoring")
def lm_scoring(spark, sf_dir):
    return ngram_trie.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_bpe_encoding")
def bpe_encoding(spark, sf_dir):
    coded = byte_bpe.coded(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


@query("op8_token_files")
def token_id_files(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.read_checked(spark, path)


@query("op10_jaccard_join", oracles.JACCARD_JOIN)
def jaccard_join(spark, sf_dir):
    return minhash_forest.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_quality_rules", oracles.QUALITY_RULES)
def quality_rules(spark, sf_dir):
    return line_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left"
    )


@query("op5_license_scan")
def license_scan(spark, sf_dir):
    return licence_rules.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("detections")


@query("op6_chat_formatting", oracles.CHAT_FORMATTING)
def chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    events = rows.unionAll(probe).withColumns({"seq": F.lit(0), "kind": F.lit("message")})
    path = scratch_path(spark, "chats")
    chat_events.formatted(events).write.parquet(path)
    return chat_events.read_back(spark.read.parquet(path))


@query("op7_html_extraction")
def html_extraction(spark, sf_dir):
    return html_cut.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op3_benchmark_decontamination")
def benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return template_leaks.leaks(docs, table(spark, sf_dir, "benchmark")).drop("row_key")


@query("op11_warc", oracles.WARC)
def warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc_files.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = warc_files.read_archives(spark, path).where("record_type != 'warcinfo' or problem is not null")
    return records.select(
        F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "problem")


@query("op12_fill_in_middle", oracles.FILL_IN_MIDDLE)
def fill_in_middle(spark, sf_dir):
    moved = middle_blocks.rearranged(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return middle_blocks.restored(moved).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


@query("op13_token_alignment")
def token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_links.measured(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
