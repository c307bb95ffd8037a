"""Prompt validation, response clean-up and the text pieces of an answer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import (
    BLOCKED_PHRASES, CODE_RESPONSE_MARKERS, PREVIEW_CHARS, PREVIEW_TAIL,
    PROMPT_AFTER_TASK, PROMPT_BEFORE_CONTEXT, PROMPT_BEFORE_TASK, PROMPT_MAX_CHARS,
    PROMPT_MESSAGES, PROMPT_MIN_CHARS, SNIPPET_DEFAULT_LANGUAGE, SNIPPET_DEFAULT_REPO,
    SNIPPET_MAX_LINES, SNIPPET_TAIL,
)
from .text import contains_any, split_lines, strip

FENCE = "```"


def prompt_verdict(query: Column) -> Column:
    """``ok`` or the first rule the prompt breaks; a null prompt counts as empty."""
    stripped = strip(query)
    return (
        F.when(query.isNull() | (stripped == ""), "empty")
        .when(F.length(stripped) < PROMPT_MIN_CHARS, "too_short")
        .when(F.length(query) > PROMPT_MAX_CHARS, "too_long")
        .when(contains_any(F.lower(query), BLOCKED_PHRASES), "restricted")
        .otherwise("ok")
    )


def verdict_message(verdict: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PROMPT_MESSAGES.items() for x in pair])
    return F.element_at(table, verdict)


def clean_response(response: Column) -> Column:
    """Strip; unwrap a leading code fence (first and last line) when it has three lines or more."""
    text = strip(F.coalesce(response, F.lit("")))
    lines = split_lines(text)
    inner = F.when(F.size(lines) >= 3, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))))
    return F.when(
        text.startswith(FENCE), strip(F.array_join(F.coalesce(inner, lines), "\n"))
    ).otherwise(text)


def response_kind(response: Column) -> Column:
    return F.when(contains_any(response, CODE_RESPONSE_MARKERS), "code").otherwise("markdown")


def display_language(language: Column) -> Column:
    """The language to highlight with; null and '' both show as plain text."""
    return F.coalesce(F.nullif(language, F.lit("")), F.lit(SNIPPET_DEFAULT_LANGUAGE))


def truncate_snippet(code: Column, max_lines: int = SNIPPET_MAX_LINES) -> Column:
    """The first ``max_lines`` lines plus marker lines; shorter code unchanged."""
    if max_lines < 1:
        raise ValueError("max_lines must be positive")
    head = F.substring_index(code, "\n", max_lines)
    return F.when(F.octet_length(head) < F.octet_length(code), F.concat(head, F.lit(SNIPPET_TAIL))).otherwise(code)


def render_snippet(language: Column, repo: Column, path: Column, function_name: Column,
                   code: Column, max_lines: int = SNIPPET_MAX_LINES) -> Column:
    lang = F.coalesce(language, F.lit(SNIPPET_DEFAULT_LANGUAGE))
    empty = F.lit("")
    return F.concat(
        F.lit("### ["), F.upper(lang), F.lit("] "),
        F.coalesce(repo, F.lit(SNIPPET_DEFAULT_REPO)), F.lit("/"), F.coalesce(path, empty),
        F.lit("\nFunction: "), F.coalesce(function_name, empty),
        F.lit("\n" + FENCE), lang, F.lit("\n"),
        truncate_snippet(F.coalesce(code, empty), max_lines), F.lit("\n" + FENCE),
    )


def strip_braces(query: Column) -> Column:
    return F.translate(query, "{}", "")


def assemble_prompt(context: Column, query: Column) -> Column:
    return F.concat(
        F.lit(PROMPT_BEFORE_CONTEXT), context, F.lit(PROMPT_BEFORE_TASK),
        strip_braces(query), F.lit(PROMPT_AFTER_TASK),
    )


def preview_title(rank: Column, repo: Column, path: Column) -> Column:
    return F.concat(rank.cast("string"), F.lit(". "), repo, F.lit(" / "), path)


def preview_code(code: Column) -> Column:
    return F.concat(F.substring(F.coalesce(code, F.lit("")), 1, PREVIEW_CHARS), F.lit(PREVIEW_TAIL))
