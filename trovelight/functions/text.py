"""String helpers with Python's notion of white space and line boundaries."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, functions as F

from ..fixed_values import PYTHON_LINE_BREAK_REGEX, PYTHON_WHITESPACE

REPLACEMENT_CHAR = "\ufffd"


def strip(text: Column) -> Column:
    """``str.strip()``: SQL ``trim`` alone would only take spaces."""
    return F.btrim(text, F.lit(PYTHON_WHITESPACE))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(n) for n in needles))


def split_lines(text: Column) -> Column:
    """``str.splitlines()`` for text that does not end in a line boundary."""
    return F.split(text, PYTHON_LINE_BREAK_REGEX, -1)


def count_lines(text: Column) -> Column:
    """Lines under universal newlines; an unterminated last line counts."""
    breaks = F.regexp_count(text, F.lit("\r\n|\r|\n"))
    unterminated = (text != "") & ~(text.endswith("\n") | text.endswith("\r"))
    return (breaks + unterminated.cast("int")).cast("long")


def decode_utf8(content: Column) -> Column:
    """UTF-8 text without the undecodable bytes.

    Each bad sequence is first replaced by U+FFFD, then dropped; a genuine U+FFFD in
    the file is dropped with them.
    """
    return F.translate(F.make_valid_utf8(content.cast("string")), REPLACEMENT_CHAR, "")


def unix_newlines(text: Column) -> Column:
    """Every line end as a single line feed, the way text files are read."""
    return F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\r", "\n")
