"""Exact top-k search of a table of query vectors against a table of points.

The score of every (query, point) pair has to be looked at, but pairs never become
rows. The query vectors are laid out as one matrix, the points stream past it in
Arrow batches, and a task keeps only its best k per query. What is shuffled is
``tasks x queries x k`` small rows; vectors and payload stay where they are read.

Query vectors are sent to the tasks in blocks of at most ``block_bytes``, cut by a hash of
the id; points are read once per block and never moved, so neither the driver nor any task
ever holds more than one block of queries. The block size changes no result. With several
blocks the points' ids, languages and vectors are stored first, so that what the points are
made by runs once and not once per block.

Cosines are bounded in single precision, tile by tile, and only pairs that may be among the
best are scored in double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..fixed_values import EXTENSION_LANGUAGE
from ..session import cut_lineage, stored
from ..settings import DEFAULTS

_QUERY_SLICE = 512   # queries scored at a time, bounds the score matrix of a batch
_POINT_SLICE = 2_048  # points whose cosines are bounded at a time
_PAIR_SLICE = 65_536  # candidate pairs re-scored at a time


class QueryMatrix:
    """Query ids, language filters ('' for none) and vectors, row by row."""

    def __init__(self, ids: pa.Array, languages: np.ndarray, vectors: np.ndarray):
        self.ids, self.languages, self.vectors = ids, languages, vectors

    @staticmethod
    def parts(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The three parts as plain Arrow and NumPy values, which any worker can unpickle."""
        ids = table.column("query_id").combine_chunks()
        languages = np.array([x or "" for x in table.column("language").to_pylist()], dtype=object)
        return ids, languages, _matrix(table.column("vector").combine_chunks())


def _matrix(column: pa.Array) -> np.ndarray:
    """List column to a float64 matrix; vectors must be present and equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(column)
    if n == 0:
        return flat.reshape(0, 0)
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    if (lengths != lengths[0]).any() or lengths[0] < 0:
        raise ValueError("vectors are missing or differ in length")
    return flat.reshape(n, lengths[0])


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _ranked(owner: np.ndarray, score: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row order by owner, descending score, name; and each row's place within its owner."""
    order = np.lexsort((name, -score, owner))
    sorted_owner = owner[order]
    starts = np.flatnonzero(np.r_[True, sorted_owner[1:] != sorted_owner[:-1]])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order, place


class _Slice:
    """The best k points so far of a few queries with one language filter."""

    def __init__(self, wanted: np.ndarray, targets: np.ndarray, floor: float):
        self.wanted, self.targets = wanted, targets
        self.near = targets.astype(np.float32)
        self.squares = (targets * targets).sum(axis=1)
        self.floor = np.full(len(wanted), floor)
        self.owner, self.score = np.empty(0, np.int64), np.empty(0)
        self.names = np.empty(0, object)

    def merge(self, owner: np.ndarray, score: np.ndarray, names: np.ndarray, k: int) -> None:
        """Only the queries with new candidates are ranked again."""
        touched = np.zeros(len(self.wanted), bool)
        touched[owner] = True
        old = touched[self.owner]
        owner, score = np.concatenate([self.owner[old], owner]), np.concatenate([self.score[old], score])
        names = np.concatenate([self.names[old], names])
        order, place = _ranked(owner, score, np.unique(names, return_inverse=True)[1])
        last = order[place == k - 1]
        self.floor[owner[last]] = np.maximum(self.floor[owner[last]], score[last])
        keep = order[place < k]
        self.owner = np.concatenate([self.owner[~old], owner[keep]])
        self.score = np.concatenate([self.score[~old], score[keep]])
        self.names = np.concatenate([self.names[~old], names[keep]])


class _TopK:
    """Best k points per query seen so far, higher score first, then smaller id.

    Vectors with components that are not finite, of queries or points, have no score.
    """

    def __init__(self, queries: QueryMatrix, k: int, threshold: float | None, metric: str):
        self.queries, self.k, self.metric, self.threshold = queries, k, metric, threshold
        self.dim = queries.vectors.shape[1]
        q = _unit_rows(queries.vectors) if metric == "cosine" else queries.vectors
        finite = np.isfinite(queries.vectors).all(axis=1)
        floor = -np.inf if threshold is None else threshold
        self.slices: list[tuple[str, _Slice]] = []
        for language in np.unique(queries.languages):
            wanted = np.flatnonzero((queries.languages == language) & finite)
            for begin in range(0, len(wanted), _QUERY_SLICE):
                part = wanted[begin:begin + _QUERY_SLICE]
                self.slices.append((language, _Slice(part, q[part], floor)))

    def add(self, ids: pa.Array, languages: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids) or not len(self.queries.languages):
            return
        if vectors.shape[1] != self.dim:
            raise ValueError(f"query dim {self.dim} differs from point dim {vectors.shape[1]}")
        finite = np.isfinite(vectors).all(axis=1)
        with np.errstate(all="ignore"):  # huge components overflow to infinite bounds, which only cost time
            x = _unit_rows(vectors) if self.metric == "cosine" else vectors
            rows_of: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for language, part in self.slices:
                if language not in rows_of:
                    rows = np.flatnonzero(finite if language == "" else finite & (languages == language))
                    rows_of[language] = rows, x[rows], x[rows].astype(np.float32)
                rows, block, near = rows_of[language]
                if len(rows):
                    find = self._near if self.metric == "cosine" else self._within
                    self._add_slice(ids, block, rows, part, *find(part, block, near))

    def _near(self, part: _Slice, block: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose cosine may count, by cosines in single precision.

        Those of unit vectors are off by less than ``slack``: each of ``dim`` products and sums
        and the two roundings before them by at most 2 ** -24 of a sum that is 1 at most.
        """
        slack = (self.dim + 8) * 2.0 ** -23
        low = np.nextafter((part.floor - slack).astype(np.float32), np.float32(-np.inf))[:, None]
        found = []
        for begin in range(0, len(near), _POINT_SLICE):
            rough = part.near @ near[begin:begin + _POINT_SLICE].T
            at = np.flatnonzero(rough >= low)
            if not len(at):
                continue
            c, r = np.divmod(at, rough.shape[1])
            many = np.bincount(c, minlength=len(low)) > self.k
            if many.any():
                # the k-th best of this tile bounds what can enter
                kth = np.full(len(low), -np.inf)
                kth[many] = np.partition(rough[many], -self.k, axis=1)[:, -self.k]
                keep = rough.ravel()[at] >= kth[c] - 2 * slack
                c, r = c[keep], r[keep]
            found.append((c, r + begin))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([c for c, _ in found]), np.concatenate([r for _, r in found])

    def _within(self, part: _Slice, block: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose distance may count. Scores lie query by query; each has bounds that rounding cannot cross."""
        squares = (block * block).sum(axis=1)
        rough = 2 * (part.targets @ block.T) - squares[None, :] - part.squares[:, None]
        slack = 1e-9 * (1 + squares[None, :] + part.squares[:, None])
        most = rough + slack
        most[np.isnan(most)] = np.inf
        hit = most >= part.floor[:, None]
        many = hit.sum(axis=1) > self.k
        if many.any():
            # the k-th best of this batch bounds what can enter; only where enough candidates are left
            least = (rough - slack)[many]
            least[np.isnan(least)] = -np.inf
            kth = np.partition(least, -self.k, axis=1)[:, -self.k]
            hit[many] &= most[many] >= kth[:, None]
        return np.nonzero(hit)

    def _add_slice(self, ids: pa.Array, block: np.ndarray, rows: np.ndarray, part: _Slice,
                   c: np.ndarray, r: np.ndarray) -> None:
        """The candidate pairs (query ``c``, point ``r``), scored and merged with the best so far."""
        if not len(r):
            return
        score = self._exact(block, part.targets, r, c)
        keep = score >= (-np.inf if self.threshold is None else self.threshold)
        keep &= (score >= part.floor[c])
        r, c, score = r[keep], c[keep], score[keep]
        if not len(r):
            return
        # Only k per query leave the batch, so many equal copies cost one sort of this batch.
        used, back = np.unique(r, return_inverse=True)
        names = ids.take(pa.array(rows[used])).to_numpy(zero_copy_only=False)
        by_name = np.unique(names, return_inverse=True)[1]
        order, place = _ranked(c, score, by_name[back])
        order = order[place < self.k]
        part.merge(c[order], score[order], names[back[order]], self.k)

    def _exact(self, block, targets, r, c) -> np.ndarray:
        """Scores that depend on the two vectors alone, so equal vectors tie exactly."""
        out = np.empty(len(r))
        for begin in range(0, len(r), _PAIR_SLICE):
            part = slice(begin, begin + _PAIR_SLICE)
            a, b = block[r[part]], targets[c[part]]
            out[part] = (a * b).sum(axis=1) if self.metric == "cosine" else -((a - b) ** 2).sum(axis=1)
        return out

    def result(self, names: list[str]) -> pa.RecordBatch:
        every = [part for _, part in self.slices]
        owner = np.concatenate([p.wanted[p.owner] for p in every] or [np.empty(0, np.int64)])
        score = np.concatenate([p.score for p in every] or [np.empty(0)])
        columns = [
            self.queries.ids.take(pa.array(owner, pa.int64())),
            pa.array([n for p in every for n in p.names.tolist()], pa.string()),
            pa.array(score if self.metric == "cosine" else -score, pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)


_HIT_COLUMNS = ["query_id", "chunk_id", "score"]


def _feed(best: _TopK, batch) -> None:
    languages = np.array(batch.column("language").to_pylist(), dtype=object)
    ids = batch.column("chunk_id")
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    best.add(ids, languages, _matrix(batch.column("vector")))


def _broadcast_job(shared, k: int, threshold: float | None, metric: str):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _TopK(QueryMatrix(*shared.value), k, threshold, metric)
        for batch in batches:
            if batch.num_rows:
                _feed(best, batch)
        yield best.result(_HIT_COLUMNS)

    return job


def best_hits(queries: DataFrame, points: DataFrame, k: int = DEFAULTS.TOP_K,
              threshold: float | None = DEFAULTS.SCORE_THRESHOLD, metric: str = "cosine",
              block_bytes: int = DEFAULTS.BROADCAST_QUERY_BYTES,
              size: "QuerySize | None" = None) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the k best points of every query.

    ``queries(query_id, language, vector)``; a null or '' language searches all points.
    Cosine keeps scores at or above ``threshold``; ``l2`` ranks by ascending squared
    distance and takes no threshold. Equal scores rank by ``chunk_id``. Fewer, larger
    read tasks (``spark.sql.files.maxPartitionBytes``) mean fewer partial results.
    ``queries`` is stored first unless its ``size`` is given, which says it is stored.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    if k < 1:
        raise ValueError("k must be positive")
    threshold = threshold if metric == "cosine" else None
    asked = queries.select("query_id", "language", "vector")
    if size is None:
        asked = cut_lineage(asked)
        size = measure(asked)
    pool = asked_points(points, size).select("chunk_id", "language", "vector")
    schema = T.StructType([
        asked.schema["query_id"],
        T.StructField("chunk_id", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ])
    context = points.sparkSession.sparkContext
    blocks = max(1, math.ceil(size.bytes / block_bytes))
    if blocks > 1:
        pool = stored(pool, "search-points")
    found = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        shared = context.broadcast(QueryMatrix.parts(block.toArrow()))
        found.append(pool.mapInArrow(_broadcast_job(shared, k, threshold, metric), schema))
    partial = reduce(DataFrame.unionByName, found)
    score = F.desc("score") if metric == "cosine" else F.asc("score")
    best_first = Window.partitionBy("query_id").orderBy(score, "chunk_id")
    return partial.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class QuerySize:
    rows: int
    dim: int
    languages: tuple[str, ...] = ()  # all that are asked for; empty when any query asks for all

    @property
    def bytes(self) -> int:
        """Vectors in double precision, and as much as a kilobyte of id and language each."""
        return self.rows * (self.dim * 8 + 1_024)


def measure(queries: DataFrame) -> QuerySize:
    """Row count, vector length and languages of a query table, before anything is fetched."""
    known = F.col("language").isin(*EXTENSION_LANGUAGE.values())
    size = queries.agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("dim"),
        F.collect_set(F.when(known, F.col("language")).otherwise("")).alias("languages")).first()
    languages = () if "" in size["languages"] else tuple(sorted(size["languages"]))
    return QuerySize(size["rows"], size["dim"] or 0, languages)


def asked_points(points: DataFrame, size: QuerySize) -> DataFrame:
    """Points of the languages asked for: folders of a table by language, else rows."""
    return points.filter(F.col("language").isin(*size.languages)) if size.languages else points


def attach_payload(hits: DataFrame, points: DataFrame, columns: list[str],
                   max_rows: int | None = None) -> DataFrame:
    """Payload columns for the hits, read from the table only now.

    ``max_rows`` is the proven size of ``hits`` (queries x k). Below the broadcast limit
    the table is probed in place; otherwise Spark picks the join from its statistics.
    """
    if max_rows is not None and max_rows <= DEFAULTS.BROADCAST_HIT_ROWS:
        return points.select("chunk_id", *columns).join(F.broadcast(hits), "chunk_id")
    # Many hits: the payload is first reduced to the ids that were hit, then joined.
    hits = cut_lineage(hits)
    payload = points.select("chunk_id", *columns).join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return payload.join(hits, "chunk_id")


def search(queries: DataFrame, points: DataFrame, k: int = DEFAULTS.TOP_K,
           threshold: float | None = DEFAULTS.SCORE_THRESHOLD, metric: str = "cosine",
           payload: tuple[str, ...] = ("language", "repo", "path", "function_name", "code"),
           **limits: int) -> DataFrame:
    """Ranked hits with their payload: ``query_id, rank, score, chunk_id, <payload>``."""
    asked = cut_lineage(queries.select("query_id", "language", "vector"))
    size = measure(asked)
    hits = best_hits(asked, points, k, threshold, metric, size=size, **limits)
    if payload:
        hits = attach_payload(hits, asked_points(points, size), list(payload), size.rows * k)
    return hits.select("query_id", "rank", "score", "chunk_id", *payload)
