"""Chunk files, dataset export and the interaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CHUNK, CHUNK_COLUMNS
from ..session import path_exists


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, replacing what is there; every field is written, even if null."""
    chunks.select(*CHUNK_COLUMNS).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_chunk_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Chunk JSON lines under the fixed schema; a missing path is a FileNotFoundError."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Chunk file not found: {path}")
    return spark.read.schema(CHUNK).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The same, for embedding: a chunk file without rows is an error."""
    chunks = load_chunk_dataset(spark, path)
    if chunks.isEmpty():
        raise ValueError("No chunks found in chunk file.")
    return chunks


def export_dataset(chunks: DataFrame, path: str) -> int:
    """Save as a columnar training dataset; returns the number of samples saved."""
    chunks.select(*CHUNK_COLUMNS).write.mode("overwrite").parquet(path)
    return chunks.sparkSession.read.parquet(path).count()


def append_interactions(records: DataFrame, path: str) -> None:
    """Append log records as JSON lines, one object per interaction."""
    records.select("timestamp", "query", "language", "response", "chunk_ids").write.mode("append").option(
        "ignoreNullFields", "false").json(path)
