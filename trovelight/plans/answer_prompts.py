"""Prompts to packed prompt texts, and responses to log records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.embedding import Encoder, HashingEncoder, embed_prompts
from ..operators.interactions import accept_prompts
from ..operators.packing import build_prompts, pack_context
from ..operators.search import search
from ..session import cut_lineage
from ..settings import DEFAULTS


def pack_answers(queries: DataFrame, points: DataFrame, k: int = DEFAULTS.TOP_K,
                 threshold: float | None = DEFAULTS.SCORE_THRESHOLD, **limits: int) -> DataFrame:
    """Encoded queries to their own columns plus ``context, packed, chunk_ids, prompt``.

    Queries without hits drop out.
    """
    hits = search(queries, points, k, threshold, **limits)
    return build_prompts(queries, pack_context(hits))


def answer_prompts(prompts: DataFrame, points: DataFrame,
                   encoder: Encoder | HashingEncoder | None = None, k: int = DEFAULTS.TOP_K,
                   threshold: float | None = DEFAULTS.SCORE_THRESHOLD, **limits: int) -> DataFrame:
    """Raw prompts ``(query_id, query)``: gate, infer language, encode, search, pack.

    Encoded prompts are checkpointed, since the search reads them more than once and a
    model should run only once per prompt.
    """
    queries = cut_lineage(embed_prompts(accept_prompts(prompts), encoder))
    return pack_answers(queries, points, k, threshold, **limits)
