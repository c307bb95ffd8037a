"""Incremental corpus load: new raw files to chunks to vectors to the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_files, latest_chunks
from ..operators.embedding import Encoder, HashingEncoder, embed_chunks
from ..sources.vector_table import VectorTable


def start_chunk_load(raw_files: DataFrame, table: VectorTable, checkpoint: str,
                     encoder: Encoder | HashingEncoder | None = None) -> StreamingQuery:
    """Load all files available now from a stream of ``(file_name, code)``, then stop.

    A load is told by its checkpoint and batch: a batch replayed after a failure is
    recognised and not loaded twice, while other streams and batch loads share the table.
    """
    encoder = encoder or HashingEncoder(table.dim)

    def load(batch: DataFrame, batch_id: int) -> None:
        points = embed_chunks(latest_chunks(chunk_files(batch)), encoder)
        table.load(points, source=checkpoint.rstrip("/"), batch=batch_id)

    return (
        raw_files.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
