"""The registered queries of the corpus operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversation_trie, decontaminate, extraction, line_dedup, packing, quality, resampling, simhash, sstable, token_counts, toxicity, warc
from .sql import ORACLES


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_words", "text")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(spark, _read(spark, sf_dir, "embeddings"), every=100, k=10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(spark, docs, toxicity.train(docs, _read(spark, sf_dir, "labels")), limit=0.7)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(spark, docs, quality.train(docs, _read(spark, sf_dir, "labels")), limit=0.5)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(spark, _read(spark, sf_dir, "pages"))
    out = warc.read_archives(spark, archives, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(spark, _read(spark, sf_dir, "documents"), shingle=4, limit=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.judge(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=13, share=20)
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(spark, _read(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1, capacity=4096)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(spark, _read(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2)
    return sstable.read_shards(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, _read(spark, sf_dir, "documents"), "piece_bpe_32k.model", limit=4096)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=10, min_words=20)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spark, _read(spark, sf_dir, "pages"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(spark, _read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_nearest_neighbours, op3_toxicity, op4_quality, op5_warc, op6_simhash, op7_decontaminate, op8_packing, op9_sstable, op10_token_counts, op11_resampling, op12_html_extraction, op13_conversation_trie)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
