"""A vector table on Parquet: create, upsert, read, compact.

Every load writes its own folder and then publishes the table's next state, one small
file that lists the folders in use; a failed load leaves nothing readers see. The table
numbers its loads. A load may carry an identity, its source and the batch's number there:
the pair that was loaded last is recognised when it comes again, an older one is refused,
and loads of other sources, or without an identity, are never taken for replays. Loads are
resolved when read: only the ids loaded since the last compaction are compared with the
base, so an upsert costs its own size and not the table's. One writer at a time is
assumed; a second one fails, because a state is never written twice.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..operators.search import search
from ..operators.upsert import last_by_key, upsert
from ..schemas import VECTOR_POINT
from ..session import list_names, path_exists, remove, stored
from ..settings import DEFAULTS

_STATE = ("kind string, seq long, folder string, rows long, dim int, metric string, encoder string, "
          "source string, batch long")


@dataclass(frozen=True)
class LoadResult:
    seq: int
    rows: int  # distinct ids written; 0 when the load had been done before
    replaced: int  # rows offered whose id another row of the load holds
    skipped: bool


class VectorTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        created = [r for r in self._state() if r["kind"] == "create"]
        if not created:
            raise FileNotFoundError(f"no vector table at {path}")
        self.dim, self.metric, self.encoder = (created[0][c] for c in ("dim", "metric", "encoder"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, metric: str = "cosine",
               encoder: str = "") -> "VectorTable":
        """Open the table, creating it if absent. An existing one must agree on all three."""
        if metric not in ("cosine", "l2"):
            raise ValueError(f"unknown metric {metric!r}")
        try:
            table = cls(spark, path)
        except FileNotFoundError:
            _publish(spark, path.rstrip("/"), [_entry(kind="create", dim=dim, metric=metric, encoder=encoder)])
            return cls(spark, path)
        asked, found = (dim, metric, encoder), (table.dim, table.metric, table.encoder)
        if asked != found:
            raise ValueError(f"vector table at {path} holds {found}, not {asked}")
        return table

    def _state(self) -> list[dict]:
        """What the table consists of: a row per folder in use and per source of loads."""
        version = _version(self.spark, self.path)
        if not version:
            return []
        rows = self.spark.read.schema(_STATE).json(f"{self.path}/state/{version}").collect()
        return [r.asDict() for r in rows]

    @staticmethod
    def _live(state: list[dict]) -> tuple[list[dict], list[dict]]:
        """The base (none or one entry), and what was loaded after it."""
        base = [r for r in state if r["kind"] == "base"]
        return base, sorted((r for r in state if r["kind"] == "load"), key=lambda r: r["seq"])

    def load(self, points: DataFrame, source: str | None = None, batch: int | None = None,
             order: Column | None = None, compact_after: int = 16) -> LoadResult:
        """Upsert ``points`` by ``chunk_id``; the last by ``order`` wins within the load.

        ``source`` and ``batch`` identify a load that may be repeated. Vectors of another
        length or with components that are missing or not finite are an error.
        """
        state = self._state()
        seq = 1 + max((r["seq"] for r in state if r["seq"] is not None), default=-1)
        if (source is None) != (batch is None):
            raise ValueError("a load's identity is its source and its batch")
        seen = next((r["batch"] for r in state if r["kind"] == "source" and r["source"] == source), None)
        if source is not None and seen is not None and batch <= seen:
            if batch == seen:
                return LoadResult(seq - 1, 0, 0, True)
            raise ValueError(f"batch {batch} of {source!r} comes after batch {seen}")
        vector = F.col("vector")
        good = (F.size(vector) == self.dim) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        error = f"vector length differs from the table's {self.dim}, or a component is missing or not finite"
        checked = F.when(F.coalesce(good, F.lit(False)), vector).otherwise(
            F.raise_error(F.lit(error)).cast("array<float>"))
        place = (F.col("path") if order is None else order).alias("_place")
        offered = stored(points.withColumn("vector", checked).select(*VECTOR_POINT.fieldNames(), place), "load")
        latest = last_by_key(offered, "chunk_id", F.col("_place")).drop("_place")
        written = self._write(latest, "load", seq)
        lost = offered.count() - written["rows"]
        kept = [r for r in state if not (r["kind"] == "source" and r["source"] == source)]
        if source is not None:
            kept.append(_entry(kind="source", seq=seq, source=source, batch=batch))
        self._publish(kept + [written])
        base, loads = self._live(kept + [written])
        if len(loads) >= compact_after:
            # Rewrite the base only when the loads have grown to a good part of it.
            if not base or sum(r["rows"] for r in loads) * 4 >= base[0]["rows"]:
                self.compact()
            else:
                self._replace(loads, self._write(self._recent(loads), "load", seq))
        return LoadResult(seq, written["rows"], lost, False)

    def _replace(self, old: list[dict], new: dict) -> None:
        """Publish a state in which one entry stands for several."""
        gone = {r["folder"] for r in old}
        self._publish([r for r in self._state() if r["folder"] is None or r["folder"] not in gone] + [new])

    def _publish(self, entries: list[dict]) -> None:
        _publish(self.spark, self.path, entries)

    def _write(self, points: DataFrame, kind: str, seq: int) -> dict:
        """Folders per language, files sorted by repository and path within.

        ``rebalance`` lets adaptive execution split a language that holds most rows over
        many files and merge the small ones.
        """
        folder = f"{self.path}/data/{kind}-{seq}-{uuid.uuid4().hex}"
        seen = Observation(f"{kind}-{seq}-{uuid.uuid4().hex}")
        laid_out = (
            points.hint("rebalance", "language")
            .observe(seen, F.count(F.lit(1)).alias("rows"))
            .sortWithinPartitions("language", "repo", "path")
        )
        laid_out.write.partitionBy("language").parquet(folder)
        return _entry(kind=kind, seq=seq, folder=folder, rows=seen.get["rows"])

    def _read_folder(self, entry) -> DataFrame:
        names = VECTOR_POINT.fieldNames()
        if not entry["rows"]:
            return self.spark.createDataFrame([], VECTOR_POINT)
        return self.spark.read.schema(VECTOR_POINT).parquet(entry["folder"]).select(*names)

    def read(self) -> DataFrame:
        """The current points, one row per id. A filter on language prunes folders."""
        base, loads = self._live(self._state())
        current = self._read_folder(base[0]) if base else None
        if not loads:
            return self.spark.createDataFrame([], VECTOR_POINT) if current is None else current
        recent = self._recent(loads)
        return recent if current is None else upsert(current, recent)

    def _recent(self, loads: list) -> DataFrame:
        """The loads as one table, the latest row of each id."""
        if len(loads) == 1:
            return self._read_folder(loads[0])
        merged = reduce(DataFrame.unionByName, (
            self._read_folder(r).withColumn("_seq", F.lit(r["seq"])) for r in loads))
        return last_by_key(merged, "chunk_id", F.col("_seq")).drop("_seq")

    def compact(self) -> int:
        """Fold all loads into one base; returns its row count."""
        base, loads = self._live(self._state())
        if not loads:
            return base[0]["rows"] if base else 0
        new = self._write(self.read(), "base", loads[-1]["seq"])
        self._replace(base + loads, new)
        return new["rows"]

    def vacuum(self) -> int:
        """Remove folders and states no longer in use; only while nobody reads the table."""
        used = {r["folder"] for r in self._state() if r["folder"]}
        version = _version(self.spark, self.path)
        old = [f"{self.path}/data/{n}" for n in list_names(self.spark, f"{self.path}/data")]
        old = [f for f in old if f not in used]
        old += [f"{self.path}/state/{n}" for n in list_names(self.spark, f"{self.path}/state") if n != version]
        for folder in old:
            remove(self.spark, folder)
        return len(old)

    def check_count(self, expected: int) -> int:
        """The number of points, which must be ``expected``."""
        found = self.read().count()
        if found != expected:
            raise ValueError(f"vector table holds {found} points, expected {expected}")
        return found

    def search(self, queries: DataFrame, encoder: str | None = None, k: int = DEFAULTS.TOP_K,
               threshold: float | None = DEFAULTS.SCORE_THRESHOLD, **options) -> DataFrame:
        """Top-k by the table's metric. Queries of another encoder are refused."""
        if encoder is not None and encoder != self.encoder:
            raise ValueError(f"queries come from encoder {encoder!r}, the table from {self.encoder!r}")
        return search(queries, self.read(), k, threshold, self.metric, **options)


def _entry(**values) -> dict:
    names = [part.strip().split(" ")[0] for part in _STATE.split(",")]
    return {n: values.get(n) for n in names}


def _version(spark: SparkSession, path: str) -> str | None:
    """The name of the latest state that was written to its end."""
    names = sorted(list_names(spark, f"{path}/state"), reverse=True)
    return next((n for n in names if path_exists(spark, f"{path}/state/{n}/_SUCCESS")), None)


def _publish(spark: SparkSession, path: str, entries: list[dict]) -> None:
    version = _version(spark, path)
    following = 0 if version is None else int(version) + 1
    rows = spark.createDataFrame([tuple(e.values()) for e in entries], _STATE)
    rows.coalesce(1).write.json(f"{path}/state/{following:010d}")
