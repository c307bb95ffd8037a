"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of ``SLICES`` partial scores, one per slice of the dimensions. Every task
holds lists of partial scores of its rows for a block of queries and works on them in NumPy:

1. It takes the k best rows of each of its lists, completes their scores, and reports the k
   best: rows (query, score) only. The k-th best report of a query is a safe cutoff: k
   candidates reach it.
2. With the cutoffs sent to all tasks, a list gives the entries that reach cutoff / SLICES.
   A candidate that reaches the cutoff is among the entries of at least one list. What its
   known parts and the limit of its unknown ones cannot lift to the cutoff is dropped.
3. The unknown parts of the rest are added up, and those that reach the cutoff are ranked.

Queries come in blocks of about ``QUERY_BLOCK``, so that what is sent to the tasks is bounded;
each block is searched against all rows. Scores are integers: components are floor(scale * x).
While they stay below 2**53 they are computed exactly in double precision, beyond in Python's
integers; beyond 64 bits they are held at the limit.

Vectors that are null or hold null or non-finite components take no part. A query meets the
vectors of its own length, but no row of its own key. Repeated rows are candidates each.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .vectors import usable

SLICES = 4
QUERY_BLOCK = 4_096
ROW_BLOCK = 2_048
SCALE = 1_024
EXACT = 2.0 ** 53
LONG = (1 << 63) - 1


def _partials(x: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Partial scores (rows x queries) of each slice of the dimensions."""
    if len(x) and len(q) and np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] >= EXACT:
        whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
        x, q = whole(x), whole(q)
    return [x[:, s] @ q[:, s].T for s in np.array_split(np.arange(x.shape[1]), min(SLICES, x.shape[1]))]


def _each_block(batch, queries: dict):
    """(keys, partial scores, query keys) by vector length, in blocks of rows."""
    keys = batch.column("key").to_numpy(zero_copy_only=False)
    rows = batch.column("vector").to_pylist()
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    for length in np.unique(lengths).tolist():
        if length in queries:
            mine = np.flatnonzero(lengths == length)
            names, q = queries[length]
            for at in range(0, len(mine), ROW_BLOCK):
                part = mine[at:at + ROW_BLOCK]
                x = np.floor(SCALE * np.array([rows[i] for i in part]))
                yield keys[part], _partials(x, q), names


def _search(rows: DataFrame, asked: list, k: int, kind: str) -> DataFrame:
    """Rows (query_id, vec_id, score) that reach their query's cutoff; ``asked`` is one block."""
    spark = rows.sparkSession
    by_length: dict[int, tuple[list, list]] = {}
    for row in asked:
        names, vectors = by_length.setdefault(len(row["vector"]), ([], []))
        names.append(row["key"])
        vectors.append(row["vector"])
    queries = {n: (np.array(names), np.floor(SCALE * np.array(q))) for n, (names, q) in by_length.items()}
    shared = spark.sparkContext.broadcast(queries)

    def report(batches):
        best: dict = {}
        for batch in batches:
            for keys, parts, names in _each_block(batch, shared.value):
                total = sum(parts[1:], parts[0])
                own = keys[:, None] == names[None, :]
                for j, name in enumerate(names.tolist()):
                    free = np.flatnonzero(~own[:, j])
                    tops = [free[np.argsort(-p[free, j], kind="stable")[:k]] if p.dtype == object or len(free) <= k
                            else free[np.argpartition(-p[free, j], k - 1)[:k]] for p in parts]
                    scores = total[np.unique(np.concatenate(tops)), j].tolist()
                    best[name] = sorted(best.get(name, []) + scores, reverse=True)[:k]
        out = [(n, max(-LONG, min(LONG, int(s)))) for n, scores in best.items() for s in scores]
        yield out

    reports = common.map_arrow(rows, report, f"query_id {kind}, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    cut = reports.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", "score")
    cutoffs = spark.sparkContext.broadcast({r["query_id"]: r["score"] for r in cut.collect()})  # one per query

    def collect(batches):
        limits = {n: np.array([cutoffs.value.get(x, -np.inf) for x in names.tolist()], float)
                  for n, (names, _) in shared.value.items()}
        by_names = {id(names): limits[n] for n, (names, _) in shared.value.items()}
        for batch in batches:
            out = []
            for keys, parts, names in _each_block(batch, shared.value):
                cutoff, m = by_names[id(names)], len(parts)
                enough = [m * p >= cutoff for p in parts]
                i, j = np.nonzero(functools.reduce(np.logical_or, enough) & (keys[:, None] != names[None, :]))
                limit = np.where(np.isinf(cutoff), np.inf, cutoff / m)[j]
                most = sum(np.where(e[i, j], p[i, j], limit) for e, p in zip(enough, parts))
                i, j = i[most >= cutoff[j]], j[most >= cutoff[j]]
                score = sum(p[i, j] for p in parts)
                good = score >= cutoff[j]
                out += [(q, v, max(-LONG, min(LONG, int(s)))) for q, v, s in zip(
                    names[j[good]].tolist(), keys[i[good]].tolist(), score[good].tolist())]
            yield out

    return common.map_arrow(rows, collect, f"query_id {kind}, vec_id {kind}, score bigint")


def top_k(rows: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 10,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best rows, ties to the smaller key.

    ``is_query`` is a condition on the key, column ``key``.
    """
    points = common.stored(usable(rows, key, vector), "points")
    kind = common.kind(points, "key")
    queries = points.where(is_query).dropDuplicates(["key", "vector"])
    blocks = max(1, -(-queries.count() // query_block))
    found = []
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b) if blocks > 1 else queries
        found.append(_search(points, block.collect(), k, kind))
    every = functools.reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = every.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
