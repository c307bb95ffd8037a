"""The corpus pipeline: documents to packed training sequences, in five stages.

1. ``language_id``: documents no language can be told of go.
2. ``minhash_dedup``: one document of each group of near duplicates stays.
3. ``secret_scan``: secrets are replaced by a mark; every document stays.
4. ``mixing``: documents come in training order, as often as their source's target asks.
5. ``best_fit_packing``: token pieces of all documents with their place in a sequence.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept; all but the
last return the columns of ``documents``. ``run`` writes every stage's result to the shared
folder as Parquet and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trovelight.llm import common, language_id, minhash_dedup, mixing, packing, secret_scan


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_first(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("minhash_dedup", deduplicated),
    ("secret_scan", redacted),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Segmentation sums, MinHash and tokenizers are not SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the whole of ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
