"""Repositories to a loaded vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fixed_values import EXTENSION_LANGUAGE
from ..operators.chunking import chunk_files, latest_chunks
from ..operators.embedding import Encoder, HashingEncoder, embed_chunks
from ..operators.selection import pending_languages, select_files, select_repos
from ..schemas import CHUNK, CHUNK_COLUMNS
from ..settings import DEFAULTS, Settings
from ..sources.vector_table import LoadResult, VectorTable


def select_raw_files(repos: DataFrame, tree: DataFrame, contents: DataFrame,
                     settings: Settings = DEFAULTS, have: DataFrame | None = None) -> DataFrame:
    """Raw files of the selected repositories: ``language, file_name, code``.

    ``tree(owner, repo_name, ordinal, path, size_bytes)`` decides; ``contents(owner,
    repo_name, path, code)`` is joined only to the files that were chosen. Languages of
    which ``have(language, file_name)`` holds enough repositories already are skipped.
    """
    if have is not None:  # one row per known language at most
        pending = pending_languages(repos.sparkSession, have, settings.MAX_REPOS)
        repos = repos.join(F.broadcast(pending), "language", "left_semi")
    chosen = select_files(
        tree, select_repos(repos, settings.LICENSE, settings.STARS, settings.MAX_REPOS),
        settings.MAX_FILES_PER_REPO, settings.MAX_DOWNLOAD_BYTES, settings.MAX_REPOS)
    most = len(EXTENSION_LANGUAGE) * settings.MAX_REPOS * settings.MAX_FILES_PER_REPO
    if most <= settings.BROADCAST_REPO_ROWS:  # then contents are probed where they lie
        chosen = F.broadcast(chosen)
    return chosen.join(contents.select("owner", "repo_name", "path", "code"),
                       ["owner", "repo_name", "path"]).select("language", "file_name", "code")


def build_corpus(raw_files: DataFrame, table: VectorTable, chunk_path: str,
                 encoder: Encoder | HashingEncoder | None = None) -> LoadResult:
    """Chunk, store the chunks, embed what was stored, load.

    The stored chunks (Parquet) sit between the two halves, so changing the encoder does
    not parse the sources again and a lost executor does not either.
    """
    encoder = encoder or HashingEncoder(table.dim)
    if table.encoder and table.encoder != encoder.name:
        raise ValueError(f"table was made for encoder {table.encoder!r}, not {encoder.name!r}")
    spark = raw_files.sparkSession
    latest_chunks(chunk_files(raw_files)).select(*CHUNK_COLUMNS).write.mode("overwrite").parquet(chunk_path)
    return table.load(embed_chunks(spark.read.schema(CHUNK).parquet(chunk_path), encoder))
