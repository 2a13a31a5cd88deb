"""The queries of this subpackage: each opN applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.llm import bpe, clustering, codebooks, embedding_dedup, fertility, hamming_search, lm, mixing, simhash, substring, token_counts, warc, wavelet


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.archive(_docs(spark, sf_dir))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_docs(spark, sf_dir))


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.measure(_docs(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_docs(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(_docs(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_docs(spark, sf_dir)).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_docs(spark, sf_dir))


def op11_centroid_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(_vectors(spark, sf_dir))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.nearest(_vectors(spark, sf_dir), F.col("vec_id") % 100 == 0)


def op13_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(_vectors(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_mix_sources, op2_embedding_dedup, op3_wavelet_shards, op4_context_mixing, op5_fertility, op6_token_counts, op7_warc, op8_substring_dedup, op9_simhash, op10_bpe, op11_centroid_screening, op12_multi_index, op13_filtering_lloyd]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op2_embedding_dedup": embedding_dedup.SQL, "op7_warc": warc.SQL, "op8_substring_dedup": substring.SQL, "op11_centroid_screening": clustering.SQL, "op13_filtering_lloyd": codebooks.SQL}
