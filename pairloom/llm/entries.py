"""Queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import bpe, fill_middle, jaccard_join, license_scan, ngram_lm, packing, private_data, quality, sstable, suffix_dedup, token_counts, whitening, winnow
from pairloom.llm._shared import documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_neighbours(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, digest=True).withColumnRenamed("text", "kept_sha256")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return sstable.read_shards(sstable.write_shards(documents(spark, sf_dir), path, end_id=2))


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    return quality.judge(documents(spark, sf_dir)).select(*counts, "base_failed", "kept", "settled")


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score_documents(documents(spark, sf_dir))
    return scored.withColumn("log_score", F.round("log_score", ngram_lm.DIGITS) + F.lit(0.0))


def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir), license_scan.known_digests(spark))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(documents(spark, sf_dir), size=3, percent=90)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.extract(documents(spark, sf_dir))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(documents(spark, sf_dir), digest=True)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_winnowing": op2_winnowing,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_token_shards": op5_token_shards,
    "op6_robust_outliers": op6_robust_outliers,
    "op7_stupid_backoff": op7_stupid_backoff,
    "op8_license_digests": op8_license_digests,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_whitening": op11_whitening,
    "op12_private_data": op12_private_data,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES: dict[str, str] = {
    "op4_suffix_array_dedup": suffix_dedup.oracle(),
    "op7_stupid_backoff": ngram_lm.oracle(),
    "op8_license_digests": license_scan.oracle(),
    "op9_ngram_jaccard": jaccard_join.oracle(size=3, percent=90),
    "op12_private_data": private_data.oracle(),
    "op13_fill_middle": fill_middle.oracle(),
}
