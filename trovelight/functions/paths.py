"""Path predicates and file-name parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import (
    ENTRY_POINT_NAMES, IGNORED_EXTENSIONS, IGNORED_NAMES, TEST_MARKERS,
)
from .text import contains_any


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """``PurePath.suffix`` of a file name, case kept; '' when there is none."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1)


def extension(path: Column) -> Column:
    return F.lower(suffix(file_name(path)))


def last_dot_part(path: Column) -> Column:
    """The tail from the last dot on, so ``path.endswith(ext)`` becomes an equality."""
    return F.when(path.contains("."), F.concat(F.lit("."), F.substring_index(path, ".", -1)))


def is_ignored(path: Column) -> Column:
    components = F.split(path, "/", -1)
    excluded = F.array(*[F.lit(n) for n in IGNORED_NAMES])
    return F.arrays_overlap(components, excluded) | extension(path).isin(*IGNORED_EXTENSIONS)


def is_test_file(path: Column) -> Column:
    return contains_any(F.lower(F.translate(path, "\\", "/")), TEST_MARKERS)


def is_entry_point(name: Column) -> Column:
    return name.isin(*ENTRY_POINT_NAMES)


def flattened_name(owner: Column, repo_name: Column, path: Column) -> Column:
    """``owner__repo__path`` with every slash of the path doubled into underscores."""
    return F.concat_ws("__", owner, repo_name, F.replace(path, F.lit("/"), F.lit("__")))


def repo_token(name: Column) -> Column:
    return F.split_part(name, F.lit("__"), F.lit(1))


def second_token(name: Column) -> Column:
    """Second ``__`` token; null when the name has no ``__``."""
    return F.when(name.contains("__"), F.split_part(name, F.lit("__"), F.lit(2)))


def has_tokens(text: Column, wanted: str) -> Column:
    """Word-token search: every alphanumeric token of ``wanted`` occurs in ``text``."""
    pattern = r"[^\p{L}\p{N}]+"
    tokens = F.split(F.lower(text), pattern)
    asked = F.array_remove(F.split(F.lower(F.lit(wanted)), pattern), "")
    return F.size(F.array_except(asked, tokens)) == 0
