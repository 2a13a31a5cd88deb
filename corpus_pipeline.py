"""A training corpus from documents: quality, near copies, repeated passages, mixture, tokens.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from needledrop.llm import bpe, fertility, mixing, simhash, substring
from needledrop.llm.common import remove, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tokeniser fertility is that of prose in their language; the rest go."""
    return fertility.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard similarity 0.8 and more): the one of smallest id."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that a document of smaller id holds."""
    return substring.cut_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the target weights of its source ask for."""
    return mixing.emit_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to, a row for each emitted document."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality", quality),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL has neither the tokenisers nor the fingerprints; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
            remove(before)
    return docs
