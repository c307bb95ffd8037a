"""Repository URL parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import DEFAULTS


def parse_repo_url(url: Column, host: str = DEFAULTS.REPO_HOST, strict: bool = False) -> Column:
    """``struct(owner, name, is_valid)``; an unusable URL gives nulls, or an error if strict."""
    base = F.rtrim(url, F.lit("/"))
    base = F.when(base.endswith(".git"), _drop_last(base, 4)).otherwise(base)
    base = F.coalesce(F.get(F.split(base, "://", 2), F.lit(1)), base)
    parts = F.split(base, "/", -1)
    valid = F.coalesce((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == host), F.lit(False))
    if strict:
        valid = F.when(valid, True).otherwise(
            F.raise_error(F.concat(F.lit("Cannot parse repository URL: "), F.coalesce(url, F.lit("null"))))
            .cast("boolean")
        )
    return F.struct(
        F.when(valid, F.get(parts, F.lit(1))).alias("owner"),
        F.when(valid, F.get(parts, F.lit(2))).alias("name"),
        valid.alias("is_valid"),
    )


def _drop_last(text: Column, n: int) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - n)
