"""The prompt side: validation, language inference, responses and log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.languages import infer_language
from ..functions.prompts import (
    clean_response, display_language, prompt_verdict, response_kind, verdict_message,
)


def validate_prompts(prompts: DataFrame) -> DataFrame:
    """Add ``is_valid``, ``reason`` (the first broken rule, or ok) and its ``message``."""
    judged = prompts.withColumn("reason", prompt_verdict(F.col("query")))
    return judged.withColumns({
        "is_valid": F.col("reason") == "ok",
        "message": verdict_message(F.col("reason")),
    })


def accept_prompts(prompts: DataFrame) -> DataFrame:
    """Valid prompts with their inferred language (null when none is named)."""
    return prompts.filter(prompt_verdict(F.col("query")) == "ok").withColumn(
        "language", infer_language(F.col("query")))


def clean_responses(responses: DataFrame) -> DataFrame:
    cleaned = responses.withColumn("response", clean_response(F.col("response")))
    return cleaned.withColumn("kind", response_kind(F.col("response")))


def interaction_records(prompts: DataFrame, responses: DataFrame, hit_lists: DataFrame,
                        at: Column | None = None) -> DataFrame:
    """One record per answered prompt: query, language, cleaned response, ids of all hits.

    ``hit_lists`` comes from the search, not from the packed context. A prompt without
    hits or without a response leaves no record.
    """
    answered = (
        prompts.select("query_id", "query", "language")
        .join(clean_responses(responses.select("query_id", "response")), "query_id")
        .join(hit_lists.select("query_id", "chunk_ids"), "query_id")
    )
    return answered.select(
        "query_id",
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        "query", "language", "response", "kind",
        display_language(F.col("language")).alias("display_language"),
        "chunk_ids",
    )
