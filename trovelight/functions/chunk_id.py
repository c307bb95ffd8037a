"""Content-derived chunk ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import ID_CODE_CHARS, ID_HASH_CHARS, ID_HASH_SEPARATOR, ID_SEPARATOR


def chunk_id(language: Column, repo: Column, path: Column, function_name: Column, code: Column) -> Column:
    """``language__repo__function__`` plus a short hash of the location and the code's head."""
    hashed = F.md5(
        F.concat_ws(
            ID_HASH_SEPARATOR, language, repo, path, function_name,
            F.substring(code, 1, ID_CODE_CHARS),
        ).cast("binary")
    )
    return F.concat_ws(
        ID_SEPARATOR, language, repo, function_name, F.substring(hashed, 1, ID_HASH_CHARS)
    )
