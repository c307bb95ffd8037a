"""SQL-callable forms of the library's row functions, as SQL functions of the session.

``register_sql_functions(spark)`` creates temporary SQL functions (``CREATE TEMPORARY
FUNCTION ... RETURN``) whose bodies are plain SQL expressions built from the same fixed
values as the Column builders. Catalyst inlines them into the calling plan: no Python
worker runs, and they fold, prune and generate code like any built-in expression.

* ``tl_parse_repo_url(url)``: ``struct<owner, name, is_valid>``, as ``parse_repo_url``;
* ``tl_infer_language(prompt)``: first language whose keyword the prompt holds, else null;
* ``tl_chunk_id(language, repo, path, function_name, code)``: as ``chunk_id``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..fixed_values import ID_CODE_CHARS, ID_HASH_CHARS, ID_HASH_SEPARATOR, ID_SEPARATOR, LANGUAGE_KEYWORDS
from ..settings import DEFAULTS


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions(host: str = DEFAULTS.REPO_HOST) -> list[str]:
    """The ``CREATE`` statements, in the order they must run."""
    base = ("CASE WHEN endswith(trim(TRAILING '/' FROM url), '.git') "
            "THEN substring(trim(TRAILING '/' FROM url), 1, length(trim(TRAILING '/' FROM url)) - 4) "
            "ELSE trim(TRAILING '/' FROM url) END")
    keywords = " ".join(
        f"WHEN {' OR '.join(f'contains(lower(prompt), {_text(w)})' for w in words)} THEN {_text(lang)}"
        for lang, words in LANGUAGE_KEYWORDS.items())
    return [
        f"CREATE OR REPLACE TEMPORARY FUNCTION tl_url_base(url STRING) RETURNS STRING RETURN {base}",
        "CREATE OR REPLACE TEMPORARY FUNCTION tl_url_parts(url STRING) RETURNS ARRAY<STRING> RETURN "
        "split(coalesce(get(split(tl_url_base(url), '://', 2), 1), tl_url_base(url)), '/', -1)",
        "CREATE OR REPLACE TEMPORARY FUNCTION tl_url_ok(url STRING) RETURNS BOOLEAN RETURN "
        f"coalesce(size(tl_url_parts(url)) >= 3 AND get(tl_url_parts(url), 0) = {_text(host)}, false)",
        "CREATE OR REPLACE TEMPORARY FUNCTION tl_parse_repo_url(url STRING) "
        "RETURNS STRUCT<owner: STRING, name: STRING, is_valid: BOOLEAN> RETURN named_struct("
        "'owner', IF(tl_url_ok(url), get(tl_url_parts(url), 1), NULL), "
        "'name', IF(tl_url_ok(url), get(tl_url_parts(url), 2), NULL), 'is_valid', tl_url_ok(url))",
        f"CREATE OR REPLACE TEMPORARY FUNCTION tl_infer_language(prompt STRING) RETURNS STRING RETURN CASE {keywords} END",
        "CREATE OR REPLACE TEMPORARY FUNCTION tl_chunk_id(language STRING, repo STRING, path STRING, "
        "function_name STRING, code STRING) RETURNS STRING RETURN "
        f"concat_ws({_text(ID_SEPARATOR)}, language, repo, function_name, substring(md5(CAST(concat_ws("
        f"{_text(ID_HASH_SEPARATOR)}, language, repo, path, function_name, substring(code, 1, {ID_CODE_CHARS})) AS BINARY)), "
        f"1, {ID_HASH_CHARS}))",
    ]


def register_sql_functions(spark: SparkSession, host: str = DEFAULTS.REPO_HOST) -> None:
    """Create (or replace) the functions in ``spark``'s session."""
    for statement in definitions(host):
        spark.sql(statement)
