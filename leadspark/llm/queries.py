"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadspark.llm import decontaminate, fill_middle, fingerprint, near_dedup, packing, quality, repeated_spans, secret_scan, sharding, token_alignment, token_counts, toxicity, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), packing.tokenizer_path())


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_documents(spark, sf_dir))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeats(_documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.filter_captures(url_filter.derived_captures(pages), url_filter.derived_entries(pages))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(_documents(spark, sf_dir))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(_documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = packing.tokenizer_path
    return token_alignment.align_tokens(_documents(spark, sf_dir), path(token_alignment.TOKENIZER_A), path(token_alignment.MODEL_B))[0]


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_middle_digests(_documents(spark, sf_dir))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), packing.tokenizer_path(token_counts.MODEL))


QUERIES = {
    "op1_pack": op1_pack,
    "op2_secrets": op2_secrets,
    "op3_repeats": op3_repeats,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_leaks": op6_leaks,
    "op7_url_lists": op7_url_lists,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_shards": op9_shards,
    "op10_fingerprints": op10_fingerprints,
    "op11_token_alignment": op11_token_alignment,
    "op12_fill_middle": op12_fill_middle,
    "op13_token_counts": op13_token_counts,
}
ORACLES: dict[str, str] = {"op7_url_lists": url_filter.SQL, "op12_fill_middle": fill_middle.SQL}
