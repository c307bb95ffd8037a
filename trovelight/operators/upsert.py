"""Last write wins, by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def last_by_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The row with the greatest ``order`` per key; equal orders rank by a hash of the row.

    One aggregate over one scan of ``rows``: ``max_by`` keeps, per key, the row of the
    greatest (order, hash). Its partial step runs in every map task, so the copies of a key,
    a hot one included, are one row per task before the shuffle, and ``rows`` is computed
    once. A null key is one key, like any other.
    """
    others = [F.col(c) for c in rows.columns if c != key]
    rank = F.struct(order.alias("order"), F.xxhash64(*others).alias("hash"))
    whole = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, rank).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in rows.columns])


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``existing`` with every row of ``incoming`` written over it; both must be unique by key
    (``last_by_key`` makes them so).

    Only the keys of ``incoming`` are compared, so the larger side is neither sorted
    nor aggregated, and is not shuffled at all while the incoming keys are small
    enough for Spark to broadcast them. ``incoming`` is read twice; store it first if it
    is costly to compute.
    """
    kept = existing.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming)


def load_counts(incoming: DataFrame, merged: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows offered, distinct ids among them, and rows in the table after the load."""
    offered = incoming.agg(
        F.count(F.lit(1)).alias("offered"), F.count_distinct(key).alias("loaded"))
    points = merged.agg(F.count(F.lit(1)).alias("points"))
    return offered.unpivot([], ["offered", "loaded"], "metric", "rows").unionByName(
        points.unpivot([], ["points"], "metric", "rows"))
