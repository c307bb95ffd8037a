"""Language lookups by extension and by prompt keywords."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import EXTENSION_LANGUAGE, LANGUAGE_KEYWORDS
from .text import contains_any


def _literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def language_of_exact(ext: Column) -> Column:
    """Language of an extension as written: ``.R`` and ``.PY`` are unknown."""
    return F.element_at(_literal_map(EXTENSION_LANGUAGE), ext)


def language_of(ext: Column) -> Column:
    return language_of_exact(F.lower(ext))


def extension_of(language: Column) -> Column:
    return F.element_at(_literal_map({v: k for k, v in EXTENSION_LANGUAGE.items()}), language)


def infer_language(prompt: Column) -> Column:
    """First language, in table order, with a keyword anywhere in the prompt; else null."""
    folded = F.lower(prompt)
    return F.coalesce(
        *[F.when(contains_any(folded, words), F.lit(lang)) for lang, words in LANGUAGE_KEYWORDS.items()]
    )
