"""Checked-out repositories to file metadata and repository records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import count_lines, decode_utf8
from ..functions.urls import parse_repo_url
from ..operators.inventory import annotate_paths, repo_files
from ..settings import DEFAULTS
from ..sources.files import list_files, read_contents


def clone_sessions(urls: DataFrame, workspace: str = DEFAULTS.REPO_WORKSPACE_DIR) -> DataFrame:
    """``session_id, url, owner, name, local_path, cloned_at`` for ``urls(url, cloned_at)``.

    The id is derived from the url and time, so a recomputed task gives the same one. Bad
    urls are an error. The checkout itself is left to git.
    """
    parsed = parse_repo_url(F.col("url"), strict=True)
    digest = F.md5(F.concat_ws("|", "url", F.col("cloned_at").cast("string")).cast("binary"))
    session = F.concat_ws("-", *[
        F.substring(digest, begin, length) for begin, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return urls.withColumns({"_repo": parsed, "session_id": session}).select(
        "session_id", "url", "_repo.owner", "_repo.name",
        F.concat_ws("/", F.lit(workspace), F.substring("session_id", 1, 8), "_repo.name").alias("local_path"),
        "cloned_at",
    )


def inventory_roots(roots: DataFrame, max_bytes: int = DEFAULTS.MAX_FILE_SIZE_BYTES) -> DataFrame:
    """File metadata with flags for every file below ``roots(root)``; one walk.

    Content is read only for files that path and size let through.
    """
    flagged = annotate_paths(list_files(roots), max_bytes)
    read = read_contents(flagged, where="is_indexed")
    lines = F.coalesce(count_lines(decode_utf8(F.col("content"))), F.lit(0).cast("long"))
    return read.withColumn("line_count", F.when(F.col("is_indexed"), lines)).drop("content")


def repo_records(sessions: DataFrame, inventory: DataFrame) -> DataFrame:
    """Repository records as flat rows: session columns, counts, language map, one file each.

    ``inventory`` is read more than once; store it first where listing is costly.
    """
    files = repo_files(inventory, ("root",)).withColumnRenamed("root", "local_path")
    return sessions.join(files, "local_path")
