"""Repository inventory: per-file metadata and per-repository roll-ups.

Everything per file is a narrow projection. Filters are kept as flags until the
roll-up, so one pass yields both the total and the indexed counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..functions.languages import language_of
from ..functions.text import count_lines
from ..functions.urls import parse_repo_url
from ..schemas import FILE_METADATA
from ..session import cut_lineage
from ..settings import DEFAULTS

REPO_KEYS = ("owner", "repo_name")


def parse_urls(urls: DataFrame, column: str = "url", host: str = DEFAULTS.REPO_HOST,
               strict: bool = False) -> DataFrame:
    """Add ``owner, name, is_valid`` parsed from a URL column."""
    parsed = urls.withColumn("_parsed", parse_repo_url(F.col(column), host, strict))
    return parsed.select(*urls.columns, "_parsed.owner", "_parsed.name", "_parsed.is_valid")


def annotate_paths(listing: DataFrame, max_bytes: int = DEFAULTS.MAX_FILE_SIZE_BYTES) -> DataFrame:
    """Flags and lookups that need only ``path`` and ``size_bytes``, never the content."""
    path, ext = F.col("path"), paths.extension(F.col("path"))
    keep = ~paths.is_ignored(path) & (F.col("size_bytes") > 0) & (F.col("size_bytes") <= max_bytes)
    language = language_of(ext)
    return listing.withColumns({
        "language": language,
        "extension": ext,
        "is_test_file": paths.is_test_file(path),
        "is_entry_point": paths.is_entry_point(paths.file_name(path)),
        "is_supported": language.isNotNull(),
        "is_indexed": keep,
    })


def file_inventory(files: DataFrame, text: str | Column = "code",
                   max_bytes: int = DEFAULTS.MAX_FILE_SIZE_BYTES) -> DataFrame:
    """All files with their flags; lines are counted only for files that are indexed."""
    content = F.col(text) if isinstance(text, str) else text
    sized = files if "size_bytes" in files.columns else files.withColumn(
        "size_bytes", F.octet_length(content).cast("long"))
    flagged = annotate_paths(sized, max_bytes)
    return flagged.withColumn("line_count", F.when(F.col("is_indexed"), count_lines(content)))


def indexed_files(inventory: DataFrame) -> DataFrame:
    return inventory.filter("is_indexed")


def repo_totals(inventory: DataFrame, keys: tuple[str, ...] = REPO_KEYS) -> DataFrame:
    """Files found and files indexed per repository, from one scan."""
    return inventory.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("is_indexed").alias("indexed_files"),
    )


def language_counts(inventory: DataFrame, keys: tuple[str, ...] = REPO_KEYS) -> DataFrame:
    """Indexed files per repository and known language, one row per pair."""
    known = indexed_files(inventory).filter(F.col("language").isNotNull())
    return known.groupBy(*keys, "language").agg(F.count(F.lit(1)).alias("files"))


def repo_languages(inventory: DataFrame, keys: tuple[str, ...] = REPO_KEYS) -> DataFrame:
    """The same histogram as one map per repository (as many entries as known languages)."""
    entries = F.array_sort(F.collect_list(F.struct("language", "files")))
    return language_counts(inventory, keys).groupBy(*keys).agg(
        F.map_from_entries(entries).alias("languages"))


def repo_summary(inventory: DataFrame, keys: tuple[str, ...] = REPO_KEYS) -> DataFrame:
    """Totals and language map per repository in a single aggregation.

    Counting per (repository, language) first leaves at most a few dozen rows per
    repository for the second step, however many files a repository holds.
    """
    per_language = inventory.groupBy(*keys, "language").agg(
        F.count(F.lit(1)).alias("_total"), F.count_if("is_indexed").alias("_indexed"))
    known = F.col("language").isNotNull() & (F.col("_indexed") > 0)
    entries = F.collect_list(F.when(known, F.struct("language", F.col("_indexed").alias("files"))))
    return per_language.groupBy(*keys).agg(
        F.sum("_total").alias("total_files"),
        F.sum("_indexed").alias("indexed_files"),
        F.map_from_entries(F.array_sort(entries)).alias("languages"),
    )


def repo_files(inventory: DataFrame, keys: tuple[str, ...] = REPO_KEYS) -> DataFrame:
    """Repository records as flat rows: the summary next to each indexed file.

    A repository without indexed files has one row without a file. The shape is the same
    for repositories of any size; the summary is one row per repository and is read twice.
    """
    summary = cut_lineage(repo_summary(inventory, keys))
    fields = [f for f in FILE_METADATA.fieldNames() if f in inventory.columns and f not in keys]
    return summary.join(indexed_files(inventory).select(*keys, *fields), list(keys), "left")


def repo_documents(inventory: DataFrame, keys: tuple[str, ...] = REPO_KEYS,
                   page_files: int = 10_000) -> DataFrame:
    """The same records nested, on request: an array of files per ``(repository, page)``.

    ``page`` is part of the key whatever the size: a repository's files are spread by path
    hash over ``pages`` pages of about ``page_files``, so no array grows with a repository.
    """
    flat = repo_files(inventory, keys)
    fields = [f for f in FILE_METADATA.fieldNames() if f in flat.columns and f not in keys]
    pages = F.greatest(F.ceil(F.col("indexed_files") / page_files), F.lit(1)).alias("pages")
    page = F.when(F.col("path").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("path"), F.col("pages")))
    slots = repo_summary(inventory, keys).select("*", pages).withColumn(
        "page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)))
    # Without this the join's partitioning by repository would serve the grouping too,
    # and all pages of a repository would meet in one task.
    placed = flat.select("*", pages).withColumn("page", page).where("path is not null").repartition(*keys, "page")
    grouped = placed.groupBy(*keys, "page").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("files"))
    return slots.join(grouped, [*keys, "page"], "left").withColumn(
        "files", F.coalesce("files", F.array().cast(grouped.schema["files"].dataType)))
