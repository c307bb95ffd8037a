"""Files to function-level chunks.

Thirteen languages are cut by regular expression and ten are kept whole, both with
built-in expressions. Python and JavaScript need a real scan of the syntax and go
through an Arrow UDF, one file at a time inside the task. All of it is narrow: chunking
needs no shuffle.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Callable, Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import (
    FUNCTION_PATTERNS, MATCH_NAME_PREFIX, WHOLE_FILE_MAX_CHARS, WHOLE_FILE_NAME,
)
from ..functions import paths
from ..functions.chunk_id import chunk_id
from ..functions.languages import language_of_exact
from ..schemas import CHUNK_COLUMNS
from .javascript_functions import javascript_functions
from .python_functions import python_functions
from .upsert import last_by_key

Extractor = Callable[[str], Iterable[tuple[str, str]]]

PYTHON_EXTRACTORS: dict[str, Extractor] = {
    "python": python_functions,
    "javascript": javascript_functions,
}

# Python's character classes spelled out for java.util.regex, whose own \s and \w are
# ASCII. With the d flag the Java dot, like Python's, stops at \n only.
_JAVA_CLASSES = (
    (r"[\s\S]", r"[\x{0}-\x{10FFFF}]"),
    (r"\s", r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"),
    (r"\w", r"[\p{L}\p{N}_]"),
)
_LITERAL_BRACE = re.compile(r"(?<![\\pPxN])\{(?!\d*,?\d*\})")


# A run of words or spaces that something disjoint must follow gains nothing from giving
# characters back, so it may be possessive; and a match that starts with a word run
# fails or succeeds alike from anywhere within the word, so one try per word is enough.
_NO_BACKTRACKING = (
    (r"\w+\s", r"\w++\s"), (r"\w+\(", r"\w++\("), (r"\s+\w", r"\s++\w"),
    (r"\s*\(", r"\s*+\("), (r"\s*{", r"\s*+{"), (r"(\w++", r"((?<!\w)\w++"),
)


def java_pattern(pattern: str) -> str:
    """A pattern in Python ``re`` syntax, rewritten to match the same text in Java."""
    for plain, eager in _NO_BACKTRACKING:
        pattern = pattern.replace(plain, eager)
    pattern = _LITERAL_BRACE.sub(r"\\{", pattern)
    for ours, theirs in _JAVA_CLASSES:
        pattern = pattern.replace(ours, theirs)
    return "(?d)" + pattern


def _may_match(pattern: str) -> Column:
    """Whether the text holds every literal the pattern insists on; a plain substring test."""
    if pattern not in FUNCTION_PATTERNS.values():
        return F.lit(True)
    words = re.findall(r"(?<!\\)\b[a-z]{2,}", pattern.replace(r"[\s\S]*?", " "))
    marks = [mark for mark, form in (("(", r"\("), ("{", "{"), ("}", "}")) if form in pattern]
    return reduce(lambda a, b: a & b, (F.col("code").contains(x) for x in [*words, *marks]))


def _up_to_last_end(pattern: str) -> Column:
    """The text up to the last place where a match can end.

    Without it, every function head after that place would be followed to the end of
    the text in vain.
    """
    code = F.col("code")
    if pattern not in FUNCTION_PATTERNS.values():
        return code
    tail = F.substring_index(code, "end" if pattern.endswith("end)") else "}", -1)
    return F.substring(code, F.lit(1), F.length(code) - F.length(tail))


def with_language(raw_files: DataFrame) -> DataFrame:
    """Add ``language`` from the (case-sensitive) suffix and ``repo`` from the name; drop unknown files."""
    return raw_files.withColumns({
        "language": language_of_exact(paths.suffix(F.col("file_name"))),
        "repo": paths.repo_token(F.col("file_name")),
    }).filter(F.col("language").isNotNull())


def _matches(patterns: Mapping[str, str]) -> list[Column]:
    """``func_0, func_1, ...`` of the row's language, one column per distinct pattern."""
    by_pattern: dict[str, list[str]] = {}
    for language, pattern in patterns.items():
        by_pattern.setdefault(pattern, []).append(language)
    return [
        F.when(F.col("language").isin(*languages) & _may_match(pattern), F.transform(
            F.regexp_extract_all(_up_to_last_end(pattern), F.lit(java_pattern(pattern)), F.lit(1)),
            lambda match, i: _piece(F.concat(F.lit(MATCH_NAME_PREFIX), i.cast("string")), match)))
        for pattern, languages in by_pattern.items()
    ]


def _piece(name: Column, code: Column) -> Column:
    return F.struct(name.alias("function_name"), code.alias("code"))


def _whole_file(ruled: Iterable[str], max_chars: int) -> Column:
    short = ~F.col("language").isin(*ruled) & (F.length("code") < max_chars)
    return F.when(short, F.array(_piece(F.lit(WHOLE_FILE_NAME), F.col("code"))))


def _extracted(extractors: Mapping[str, Extractor]) -> Column:
    """Pieces found by Python callables. Rows of other languages send only a null to the worker."""

    @F.arrow_udf("array<struct<function_name:string,code:string>>")
    def extract(languages: pa.Array, codes: pa.Array) -> pa.Array:
        found = [
            None if code is None else [
                {"function_name": name, "code": body} for name, body in extractors[language](code)]
            for language, code in zip(languages.to_pylist(), codes.to_pylist())
        ]
        return pa.array(found, pa.list_(pa.struct([("function_name", pa.string()), ("code", pa.string())])))

    mine = F.col("language").isin(*extractors)
    return extract(F.when(mine, F.col("language")), F.when(mine, F.col("code")))


def _explode(files: DataFrame, pieces: list[Column]) -> DataFrame:
    """Chunk rows with their id; ``ordinal`` is the position within the file."""
    cut = files.select(
        "language", "repo", F.col("file_name").alias("path"),
        F.posexplode(F.coalesce(*pieces)).alias("ordinal", "piece"),
    ).select("language", "repo", "path", "ordinal", "piece.*")
    identified = cut.withColumn("chunk_id", chunk_id(*[
        F.col(c) for c in ("language", "repo", "path", "function_name", "code")]))
    return identified.select(*CHUNK_COLUMNS, "ordinal")


def regex_chunks(files: DataFrame, patterns: Mapping[str, str] = FUNCTION_PATTERNS) -> DataFrame:
    """Chunks of the languages cut by pattern."""
    return _explode(files.filter(F.col("language").isin(*patterns)), _matches(patterns))


def whole_file_chunks(files: DataFrame, max_chars: int = WHOLE_FILE_MAX_CHARS) -> DataFrame:
    """One ``default`` chunk per short file of a language without a function rule."""
    return _explode(files, [_whole_file([*FUNCTION_PATTERNS, *PYTHON_EXTRACTORS], max_chars)])


def extracted_chunks(files: DataFrame, extractors: Mapping[str, Extractor]) -> DataFrame:
    """Chunks of the languages cut by a Python callable ``code -> (name, source) pairs``."""
    return _explode(files.filter(F.col("language").isin(*extractors)), [_extracted(extractors)])


def python_chunks(files: DataFrame) -> DataFrame:
    return extracted_chunks(files, {"python": python_functions})


def javascript_chunks(files: DataFrame) -> DataFrame:
    return extracted_chunks(files, {"javascript": javascript_functions})


def chunk_files(raw_files: DataFrame, extractors: Mapping[str, str | Extractor] | None = None,
                max_chars: int = WHOLE_FILE_MAX_CHARS) -> DataFrame:
    """All chunks of ``raw_files(file_name, code)``; files that yield nothing drop out.

    ``extractors`` adds or replaces languages: a pattern in Python ``re`` syntax, or a
    callable. Every remaining language is kept whole. The source is read once: each
    row takes the branch of its language within a single projection.
    """
    rules: dict[str, str | Extractor] = {**FUNCTION_PATTERNS, **PYTHON_EXTRACTORS, **(extractors or {})}
    patterns = {lang: rule for lang, rule in rules.items() if isinstance(rule, str)}
    callables = {lang: rule for lang, rule in rules.items() if not isinstance(rule, str)}
    pieces = [*_matches(patterns), _whole_file(rules, max_chars)]
    if callables:
        pieces.append(_extracted(callables))
    return _explode(with_language(raw_files), pieces)


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """One row per id. Repeats of an id within a corpus: the last by path and ordinal stays."""
    return last_by_key(chunks, "chunk_id", F.struct("path", "ordinal"))
