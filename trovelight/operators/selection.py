"""Corpus selection: which repositories, and which of their files, enter the corpus.

Ranks are ``row_number() <= n`` windows, for which Catalyst plans a partial limit
before the shuffle: a language or repository holding most rows sends at most ``n``
rows per map task to the task that ranks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..fixed_values import EXTENSION_LANGUAGE
from ..functions import paths
from ..functions.languages import extension_of, language_of_exact
from ..settings import DEFAULTS


def qualify_repos(repos: DataFrame, license: str = DEFAULTS.LICENSE, stars: int = DEFAULTS.STARS,
                  language: str | None = None) -> DataFrame:
    kept = repos.filter((F.col("license") == license) & (F.col("stars") >= stars))
    return kept.filter(F.col("language") == language) if language else kept


def distinct_repos(repos: DataFrame) -> DataFrame:
    """One row per language and full name: the first seen when listed by stars."""
    return repos.groupBy("language", "full_name").agg(F.max("stars").alias("stars"))


def select_repos(repos: DataFrame, license: str = DEFAULTS.LICENSE, stars: int = DEFAULTS.STARS,
                 max_repos: int = DEFAULTS.MAX_REPOS) -> DataFrame:
    """The most-starred qualifying repositories of every language."""
    by_stars = Window.partitionBy("language").orderBy(F.desc("stars"), "full_name")
    ranked = distinct_repos(qualify_repos(repos, license, stars)).withColumn(
        "rank", F.row_number().over(by_stars))
    return ranked.filter(F.col("rank") <= max_repos).select(
        "language", "full_name",
        F.split_part("full_name", F.lit("/"), F.lit(1)).alias("owner"),
        F.split_part("full_name", F.lit("/"), F.lit(2)).alias("repo_name"),
        "stars", "rank",
    )


def candidate_files(tree: DataFrame, selected: DataFrame | None = None,
                    max_repos: int | None = None) -> DataFrame:
    """Tree entries whose path ends in the extension of the language asked for.

    With ``selected`` (output of :func:`select_repos`), an entry is kept for each language
    its repository was selected under; without it, for the language its own extension
    names. ``max_repos`` is the rank limit ``selected`` was made with: it bounds the table
    at known languages x ``max_repos`` rows, and a table proven small is broadcast.
    """
    tail = paths.last_dot_part(F.col("path"))
    if selected is None:
        return tree.withColumn("language", language_of_exact(tail)).filter(F.col("language").isNotNull())
    wanted = selected.filter(F.col("language").isin(*EXTENSION_LANGUAGE.values())).select(
        "owner", "repo_name", "language", "rank", extension_of(F.col("language")).alias("_ext"))
    if max_repos is not None and max_repos * len(EXTENSION_LANGUAGE) <= DEFAULTS.BROADCAST_REPO_ROWS:
        wanted = F.broadcast(wanted.filter(F.col("rank") <= max_repos))
    return tree.withColumn("_ext", tail).join(
        wanted.drop("rank"), ["owner", "repo_name", "_ext"]).drop("_ext")


def select_files(tree: DataFrame, selected: DataFrame | None = None,
                 max_files: int = DEFAULTS.MAX_FILES_PER_REPO,
                 max_bytes: int = DEFAULTS.MAX_DOWNLOAD_BYTES,
                 max_repos: int | None = None) -> DataFrame:
    """First files of each repository in tree order, then the size gate.

    The cap comes first: an oversized file uses up a place. ``tree`` carries
    ``owner, repo_name, ordinal, path, size_bytes``; contents stay out of the shuffle.
    """
    in_tree_order = Window.partitionBy("language", "owner", "repo_name").orderBy("ordinal", "path")
    capped = (
        candidate_files(tree, selected, max_repos)
        .select("language", "owner", "repo_name", "ordinal", "path", "size_bytes")
        .withColumn("position", F.row_number().over(in_tree_order))
        .filter(F.col("position") <= max_files)
    )
    return capped.filter(F.col("size_bytes") < max_bytes).withColumn(
        "file_name", paths.flattened_name(F.col("owner"), F.col("repo_name"), F.col("path")))


def scrape_summary(raw_files: DataFrame) -> DataFrame:
    """Per language folder: distinct repositories (second name token) and files."""
    return raw_files.groupBy("language").agg(
        F.count_distinct(paths.second_token(F.col("file_name"))).alias("repos"),
        F.count(F.lit(1)).alias("files"),
    )


def pending_languages(spark: SparkSession, raw_files: DataFrame,
                      required_repos: int = DEFAULTS.MAX_REPOS) -> DataFrame:
    """Known languages whose folder does not yet hold enough repositories."""
    names = F.array(*[F.lit(v) for v in EXTENSION_LANGUAGE.values()])
    known = spark.range(1).select(F.explode(names).alias("language"))
    done = scrape_summary(raw_files).filter(F.col("repos") >= required_repos).select("language")
    return known.join(done, "language", "left_anti")
