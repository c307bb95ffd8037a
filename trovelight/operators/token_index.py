"""Inverted token lists over text fields of points, and lookups that read only the lists asked.

``build_token_index`` writes one row per (field, token, point) with a token-hash bucket as a
folder level, sorted by token inside each bucket: a lookup names its buckets, so Spark
prunes every other folder before reading, and Parquet's min/max statistics on ``token``
skip row groups inside the ones read. Several tokens are answered by intersecting counts:
a point qualifies when it holds every distinct token asked, counted on the lists alone.

Tokens are those of ``has_tokens``: lower-cased runs of letters and digits. Null fields
give no tokens; an empty question matches every point that has the field (as
``has_tokens`` does, nothing being missing). Rows repeated under one id count once.
"""

from __future__ import annotations

import zlib

import regex

from pyspark.sql import DataFrame, functions as F

from trovelight.session import new_folder

SPLIT = r"[^\p{L}\p{N}]+"
BUCKETS = 64  # folders per field; a lookup of k tokens opens at most k of them


def tokens_of(text: str) -> list[str]:
    """Distinct tokens of a question, split as the index splits fields."""
    return sorted({t for t in regex.split(SPLIT, text.lower()) if t})


def bucket_of(token: str, buckets: int = BUCKETS) -> int:
    """Bucket of a token; the same rule on the driver and in the build (CRC-32 of UTF-8)."""
    return zlib.crc32(token.encode()) % buckets


def build_token_index(points: DataFrame, fields: tuple[str, ...], id_col: str = "chunk_id",
                      path: str | None = None, buckets: int = BUCKETS) -> str:
    """Write the lists of ``fields`` of ``points``; returns the folder.

    The job explodes each field into distinct tokens, deals rows by (field, bucket) and sorts
    by token within them. ``has_field`` rows (token null) mark points that have the field, so
    that an empty question can be answered from the lists too.
    """
    spark = points.sparkSession
    path = path or new_folder(spark, "token-index")
    parts = []
    for field in fields:
        tokens = F.array_distinct(F.array_remove(F.split(F.lower(F.col(field)), SPLIT), ""))
        parts.append(points.where(F.col(field).isNotNull()).select(
            F.lit(field).alias("field"), F.col(id_col).alias("point_id"),
            F.explode(F.concat(F.array(F.lit(None).cast("string")), tokens)).alias("token")))
    lists = parts[0]
    for part in parts[1:]:
        lists = lists.unionByName(part)
    lists = lists.distinct().withColumn(
        "bucket", F.coalesce(F.crc32(F.col("token")) % buckets, F.lit(-1)).cast("int"))
    (lists.repartition("field", "bucket").sortWithinPartitions("token", "point_id")
     .write.partitionBy("field", "bucket").parquet(path))
    return path


def lookup(index: DataFrame, field: str, question: str, buckets: int = BUCKETS) -> DataFrame:
    """``point_id`` of every point whose ``field`` holds all tokens of ``question``."""
    asked = tokens_of(question)
    if not asked:
        return index.where((F.col("field") == field) & (F.col("bucket") == -1)).select("point_id")
    wanted = sorted({bucket_of(t, buckets) for t in asked})
    hits = index.where((F.col("field") == field) & F.col("bucket").isin(wanted) & F.col("token").isin(asked))
    counted = hits.groupBy("point_id").agg(F.count_distinct("token").alias("held"))
    return counted.where(F.col("held") == len(asked)).select("point_id")


def open_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
