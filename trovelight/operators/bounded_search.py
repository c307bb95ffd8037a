"""Exact cosine top-k that skips files by triangle bounds.

Load (``write_cells``): every valid point is made a unit vector and put in the cell of its
nearest pivot; a cell over ``cell_rows`` points is dealt into sub-cells by a hash, so no cell
grows with a hot group of copies. Points are written one folder per cell, and a small table
keeps per cell its centre (the pivot) and radius: the largest angle between a point of the
cell and the centre. Pivots are the first ``pivots`` valid points in hash order: a bounded
sample (``pivots`` x dimension doubles) that every task gets.

Search (``bounded_top_k``): for query q and a cell of centre c and radius r, no point of the
cell scores above cos(max(0, angle(q, c) - r)). Pass 1 reads, per query, only its most
promising cell and keeps its k-th score as a cutoff (the threshold if fewer pass). Pass 2 reads
the cells whose bound reaches the cutoff; all others are skipped unread. Points of a cell meet
the queries that need it in blocks of at most ``query_block`` queries (the points are sent
once per block), so no task holds more than one block of queries and one cell.

Results equal a full scan: scores of every point at or above ``threshold`` and in the query's
language (a null or empty language asks all points), best ``k`` per query, equal scores by
``chunk_id``. Null, zero or non-finite vectors take no part; points of another dimension than
the pivots sit in a cell of their own that is always read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trovelight.session import new_folder

PIVOTS = 64
CELL_ROWS = 50_000
QUERY_BLOCK = 1_024
SLACK = 1e-9  # bounds are computed with acos in doubles; cells this close are read

POINT_SCHEMA = "chunk_id string, language string, unit array<double>, pivot int, near double"


def _units(column: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Unit vectors (None where invalid) of a list column."""
    out = []
    for v in column.to_pylist():
        if v is None or any(x is None for x in v):
            out.append(None)
            continue
        a = np.asarray(v, dtype=np.float64)
        norm = float(np.sqrt(a @ a)) if a.size else 0.0
        out.append(a / norm if np.isfinite(a).all() and norm > 0 and math.isfinite(norm) else None)
    return out, np.array([u is not None for u in out], dtype=bool)


def _nearest(units: list[np.ndarray | None], pivots: np.ndarray):
    """Per unit vector: index of its nearest pivot and the cosine to it (-1, -1.0 off-dimension)."""
    pivot, near = [], []
    for u in units:
        if u is None or pivots.size == 0 or u.size != pivots.shape[1]:
            pivot.append(-1)
            near.append(-1.0)
            continue
        c = pivots @ u
        j = int(np.argmax(c))
        pivot.append(j)
        near.append(float(min(1.0, c[j])))
    return pivot, near


def write_cells(points: DataFrame, pivots: int = PIVOTS, cell_rows: int = CELL_ROWS, path: str | None = None) -> str:
    """Write ``points(chunk_id, language, vector)`` as cells; returns the folder."""
    spark = points.sparkSession
    path = path or new_folder(spark, "cells")
    rows = points.select("chunk_id", "language", "vector")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sample = (rows.where(F.col("vector").isNotNull() & ~odd & F.exists("vector", lambda x: x != 0))
              .orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots).select("vector").collect())
    units, _ = _units(pa.array([r[0] for r in sample], pa.list_(pa.float64())))
    dims = [u.size for u in units if u is not None]
    dim = max(set(dims), key=dims.count) if dims else 0
    matrix = np.array([u for u in units if u is not None and u.size == dim]).reshape(-1, dim)
    shared = spark.sparkContext.broadcast(matrix)

    def place(batches):
        for batch in batches:
            u, good = _units(batch.column("vector"))
            pivot, near = _nearest(u, shared.value)
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([
                batch.column("chunk_id").take(pa.array(keep, pa.int64())),
                batch.column("language").take(pa.array(keep, pa.int64())),
                pa.array([u[i].tolist() for i in keep], pa.list_(pa.float64())),
                pa.array([pivot[i] for i in keep], pa.int32()),
                pa.array([near[i] for i in keep], pa.float64())], names=["chunk_id", "language", "unit", "pivot", "near"])

    placed = rows.mapInArrow(place, POINT_SCHEMA)
    # Cells per pivot by count (one row per pivot, so the table is as small as the sample).
    per_pivot = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).select(
        "pivot", F.greatest(F.lit(1), F.ceil(F.col("n") / cell_rows)).cast("int").alias("subs"))
    celled = placed.join(F.broadcast(per_pivot), "pivot").withColumn(
        "sub", F.pmod(F.xxhash64("chunk_id"), F.col("subs")).cast("int")).drop("subs")
    celled.repartition("pivot", "sub").write.partitionBy("pivot", "sub").parquet(f"{path}/points")
    stored = spark.read.parquet(f"{path}/points")
    cells = stored.groupBy("pivot", "sub").agg(F.min("near").alias("low"), F.count(F.lit(1)).alias("rows"))
    cells.write.parquet(f"{path}/cells")
    spark.createDataFrame([(i, matrix[i].tolist()) for i in range(matrix.shape[0])],
                          "pivot int, centre array<double>").write.parquet(f"{path}/pivots")
    return path


def _with_pivot_cosines(queries: DataFrame, matrix: np.ndarray, spark) -> DataFrame:
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches):
        for batch in batches:
            u, good = _units(batch.column("vector"))
            cos = [(shared.value @ x).clip(-1, 1).tolist() if x is not None and shared.value.size and x.size == shared.value.shape[1]
                   else None for x in u]
            yield pa.RecordBatch.from_arrays([
                batch.column("query_id"), batch.column("language"),
                pa.array([x.tolist() if x is not None else None for x in u], pa.list_(pa.float64())),
                pa.array(cos, pa.list_(pa.float64()))], names=["query_id", "language", "unit", "cos"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "language", "vector").mapInArrow(
        run, f"query_id {kind}, language string, unit array<double>, cos array<double>")


def _scorer(k: int, threshold: float):
    def score(key, asked: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "chunk_id": [], "score": []}
        if len(asked) and len(pts):
            pv = list(pts["unit"])
            plang = pts["language"].to_numpy(dtype=object)
            ids = pts["chunk_id"].to_numpy(dtype=object)
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(pv):
                by_dim.setdefault(len(v), []).append(i)
            mats = {d: (np.array([pv[i] for i in rows], dtype=np.float64), np.array(rows)) for d, rows in by_dim.items()}
            for qid, lang, unit, cut in zip(asked["query_id"], asked["language"], asked["unit"], asked["cutoff"]):
                if unit is None or len(unit) not in mats:
                    continue
                m, rows = mats[len(unit)]
                s = m @ np.asarray(unit, dtype=np.float64)
                keep = s >= max(threshold, cut)
                if lang is not None and lang != "":
                    keep &= plang[rows] == lang
                chosen = rows[keep]
                if chosen.size == 0:
                    continue
                order = sorted(zip(-s[keep], ids[chosen]))[:k]
                out["query_id"] += [qid] * len(order)
                out["chunk_id"] += [c for _, c in order]
                out["score"] += [-x for x, _ in order]
        return pd.DataFrame({"query_id": pd.Series(out["query_id"], dtype=object),
                             "chunk_id": pd.Series(out["chunk_id"], dtype=object),
                             "score": pd.Series(out["score"], dtype="float64")})

    return score


def _read(pairs: DataFrame, stored: DataFrame, k: int, threshold: float, query_block: int, kind: str) -> DataFrame:
    """Best k per (query, cell) of the pairs ``(query_id, language, unit, cutoff, pivot, sub)``."""
    per_cell = pairs.groupBy("pivot", "sub").agg(F.count(F.lit(1)).alias("nq")).select(
        "pivot", "sub", F.greatest(F.lit(1), F.ceil(F.col("nq") / query_block)).cast("int").alias("blocks"))
    asked = pairs.join(per_cell, ["pivot", "sub"]).withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    pts = stored.join(per_cell, ["pivot", "sub"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["pivot", "sub", "block"]
    return asked.select(*keys, "query_id", "language", "unit", "cutoff").groupBy(*keys).cogroup(
        pts.select(*keys, "chunk_id", "language", "unit").groupBy(*keys)).applyInPandas(
        _scorer(k, threshold), f"query_id {kind}, chunk_id string, score double")


def bounded_top_k(queries: DataFrame, store: str, k: int = 5, threshold: float = 0.2,
                  query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(hits, cells_read)``: hits ``query_id, chunk_id, score, rank``; per query the cells read.

    ``queries(query_id, language, vector)``; ``store`` is a folder of ``write_cells``.
    """
    spark = queries.sparkSession
    stored = spark.read.parquet(f"{store}/points")
    cells = spark.read.parquet(f"{store}/cells")
    centres = spark.read.parquet(f"{store}/pivots").orderBy("pivot").collect()  # the bounded sample
    matrix = np.array([r["centre"] for r in centres], dtype=np.float64).reshape(len(centres), -1)
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = _with_pivot_cosines(queries, matrix, spark)
    asked.write.parquet(folder := new_folder(spark, "bounded-queries"))
    asked = spark.read.parquet(folder)

    on_pivot = asked.select("query_id", "language", "unit", F.posexplode("cos").alias("pivot", "qc"))
    bound = F.cos(F.greatest(F.lit(0.0), F.acos(F.col("qc")) - F.acos(F.least(F.lit(1.0), F.col("low")))))
    pairs = on_pivot.join(cells, "pivot").select("query_id", "language", "unit", "pivot", "sub", bound.alias("bound"))
    # Points off the pivots' dimension are in cell -1, always read.
    pairs = pairs.unionByName(asked.where(F.col("unit").isNotNull()).select(
        "query_id", "language", "unit", F.lit(-1).alias("pivot"), F.lit(0).alias("sub"), F.lit(1.0).alias("bound"))
        .join(cells.where("pivot = -1").select("pivot", "sub"), ["pivot", "sub"]))
    pairs.write.parquet(folder := new_folder(spark, "bounded-pairs"))
    pairs = spark.read.parquet(folder)

    best = pairs.groupBy("query_id").agg(F.max_by(F.struct("pivot", "sub"), F.struct("bound", "pivot", "sub")).alias("c"))
    first = pairs.join(best.select("query_id", F.col("c.pivot").alias("pivot"), F.col("c.sub").alias("sub")),
                       ["query_id", "pivot", "sub"]).withColumn("cutoff", F.lit(threshold))
    found = _read(first, stored, k, threshold, query_block, kind)
    kth = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))) \
        .where(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    cut = pairs.join(kth, "query_id", "left").withColumn("cutoff", F.greatest(F.lit(threshold), F.coalesce("kth", F.lit(threshold))))
    needed = cut.where(F.col("bound") >= F.col("cutoff") - SLACK)
    needed.write.parquet(folder := new_folder(spark, "bounded-needed"))
    needed = spark.read.parquet(folder)

    hits = _read(needed, stored, k, threshold, query_block, kind)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    read = needed.groupBy("query_id").agg(F.count(F.lit(1)).alias("cells_read")).join(
        pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("cells")), "query_id", "right").fillna(0, ["cells_read"])
    return ranked.where(F.col("rank") <= k), read
