"""Ranked hits to prompt text. Every group here is one query's hits, at most k rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..fixed_values import CONTEXT_MAX_CHARS, PREVIEW_HITS, SNIPPET_MAX_LINES
from ..functions.prompts import assemble_prompt, preview_code, preview_title, render_snippet


def render_hits(hits: DataFrame, max_lines: int = SNIPPET_MAX_LINES) -> DataFrame:
    columns = [F.col(c) for c in ("language", "repo", "path", "function_name", "code")]
    return hits.select("query_id", "rank", "chunk_id", render_snippet(*columns, max_lines).alias("snippet"))


def mark_packed(snippets: DataFrame, max_chars: int = CONTEXT_MAX_CHARS) -> DataFrame:
    """Flag the snippets that fit, in rank order, before the first that does not.

    Lengths are positive, so once the running total passes the budget it stays past it.
    """
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return snippets.withColumn(
        "packed", F.sum(F.length("snippet")).over(so_far) <= max_chars)


def pack_context(hits: DataFrame, max_chars: int = CONTEXT_MAX_CHARS,
                 max_lines: int = SNIPPET_MAX_LINES) -> DataFrame:
    """Per query: the context, how many snippets it holds, and the ids of all hits.

    A query whose first snippet is already too long keeps its row, with empty context.
    """
    marked = mark_packed(render_hits(hits, max_lines), max_chars)
    in_order = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "packed", "snippet")))
    return marked.groupBy("query_id").agg(in_order.alias("_hits")).select(
        "query_id",
        F.array_join(F.transform(F.filter("_hits", lambda h: h.packed), lambda h: h.snippet), "").alias("context"),
        F.size(F.filter("_hits", lambda h: h.packed)).alias("packed"),
        F.transform("_hits", lambda h: h.chunk_id).alias("chunk_ids"),
    )


def build_prompts(queries: DataFrame, packed: DataFrame) -> DataFrame:
    """The full prompt text of every query that has hits, next to the query's own columns."""
    joined = queries.drop("vector").join(packed, "query_id")
    return joined.withColumn("prompt", assemble_prompt(F.col("context"), F.col("query")))


def hit_ids(hits: DataFrame) -> DataFrame:
    """Ids of a query's hits, best first."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    return hits.groupBy("query_id").agg(F.transform(ranked, lambda h: h.chunk_id).alias("chunk_ids"))


def preview_hits(hits: DataFrame, top: int = PREVIEW_HITS) -> DataFrame:
    """Title and opening characters of the leading hits."""
    return hits.filter(F.col("rank") <= top).select(
        "query_id", "rank",
        preview_title(F.col("rank"), F.col("repo"), F.col("path")).alias("title"),
        preview_code(F.col("code")).alias("preview"),
        "language",
    )
