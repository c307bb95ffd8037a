"""Prompt stream against a static corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.embedding import Encoder, HashingEncoder
from ..operators.interactions import interaction_records
from ..plans.answer_prompts import answer_prompts
from ..settings import DEFAULTS


def start_prompt_answers(prompts: DataFrame, points: DataFrame, out: str, checkpoint: str,
                         encoder: Encoder | HashingEncoder | None = None, k: int = DEFAULTS.TOP_K,
                         threshold: float | None = DEFAULTS.SCORE_THRESHOLD, log: str | None = None,
                         respond: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Answer all prompts available now from a stream of ``(query_id, query)``.

    Each batch replaces its own folder ``<out>/run=<checkpoint's digest>/batch=<id>``, so a
    replay leaves no duplicates and streams with other checkpoints keep their answers.
    Top-k ranking is a window, hence the batch function. ``points`` is read once per batch;
    store it first if it is costly to compute.

    With ``log`` and ``respond`` the stream also appends interaction records: ``respond``
    turns the batch's answers into ``(query_id, response)`` rows.
    """
    run = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def answer(batch: DataFrame, batch_id: int) -> None:
        rows = answer_prompts(batch, points, encoder, k, threshold)
        place = f"run={run}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(f"{out}/{place}")
        if log and respond:
            written = batch.sparkSession.read.schema(rows.schema).parquet(f"{out}/{place}")
            records = interaction_records(written, respond(written), written.select("query_id", "chunk_ids"))
            records.write.mode("overwrite").json(f"{log}/{place}")

    return (
        prompts.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
