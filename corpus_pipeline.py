"""The corpus pipeline: filters, deduplicates, cleans and packs documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A stage's result is written as Parquet and read again as the next one's
input, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, near_copies, packing, secret_scan, toxicity
from gridloom.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more in the Jaccard of 5-word shingles join.

    SimHash's grid finds groups, exact Jaccard verifies them, and an exact pass adds the links that
    lie beyond its 4 bits.
    """
    return near_copies.deduplicate(docs, threshold=0.8, words=5, bits=4)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by their kind."""
    return secret_scan.redact(docs, secret_scan.Scanner())


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens lie in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_tokens),
]

#: A learnt score, components and a tokenizer are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before it are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
