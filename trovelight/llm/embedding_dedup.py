"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest pivots in order of similarity; pivots are vectors of the
table itself, a documented number of them by hash of their key. Two vectors are candidates if
they share enough of their nearest pivots, and are verified by cosine in double precision.

The inverted lists (pivot to vectors) are searched in blocks: a long list is cut into parts,
each part meets every other part and itself in a task of its own. A pair that several lists
hold is taken in the list of its smallest shared pivot only. A task returns counts of links
per vector and a spanning forest of its links, never the pairs.

Equal vectors form a class that is indexed once. The number of pivots grows as the square
root of the number of classes, so lists do too, up to ``MOST_PIVOTS``, which bounds what is
sent to the tasks. Measured recall of links at cosine 0.9 and more: see the README.

Vectors that are null, zero, or hold null or non-finite components link with nothing; so do
those whose length is not the commonest one. Rows with a null key stay and link with nothing;
rows that share a key count as one vector in components, each as itself in numbers of links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .components import components
from .vectors import matrix, usable

NEAREST, SHARED = 10, 2
MOST_PIVOTS = 65_536
BLOCK = 1_024


def described(classes: DataFrame, pivots: np.ndarray, nearest: int, kind: str) -> DataFrame:
    """(node, copies, vector, pivots in order of similarity); vectors at unit length."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def start():
        unit_pivots = shared.value

        def work(batch):
            x = matrix(batch.column("vector"))
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            order = []
            for at in range(0, len(x), 1024):
                close = x[at:at + 1024] @ unit_pivots.T
                top = np.argpartition(-close, nearest - 1, axis=1)[:, :nearest]
                rank = np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable")
                order += np.take_along_axis(top, rank, 1).tolist()
            return [batch.column("node"), batch.column("copies"), [r.tobytes() for r in x], order]

        return work

    rows = classes.select("node", "copies", "vector")
    return common.map_batches(rows, start, f"node {kind}, copies bigint, vector binary, nearest array<int>")


def _forest(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row of its component."""
    label = np.arange(len(links))
    while True:
        lowest = np.where(links, label[None, :], len(links)).min(axis=1)
        lowest = np.minimum(label, lowest)
        lowest = lowest[lowest]
        if (lowest == label).all():
            return label
        label = lowest


def _search_block(table: pa.Table, threshold: float, shared: int) -> pa.Table:
    """Links of one block, of the pairs whose smallest shared pivot is this list's."""
    pivot, side = table.column("pivot")[0].as_py(), table.column("left").to_numpy()
    nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    x = np.stack([np.frombuffer(v) for v in table.column("vector").to_pylist()])
    near = matrix(table.column("nearest")).astype(np.int64)
    names, place = np.unique(near, return_inverse=True)
    has = np.zeros((len(x), len(names)), np.float32)
    np.put_along_axis(has, place.reshape(near.shape), 1.0, axis=1)
    lower = has[:, names < pivot]
    pairs = (has @ has.T >= shared) & (lower @ lower.T == 0)
    pairs &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    pairs &= nodes[:, None] != nodes[None, :]
    pairs &= x @ x.T >= threshold
    count = pairs @ copies
    label = _forest(pairs)
    some = np.flatnonzero(count)
    kind = table.schema.field("node").type
    return pa.table({"node": pa.array(nodes[some], kind), "other": pa.array(nodes[label[some]], kind),
                     "links": pa.array(count[some], pa.int64())})


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9,
                 nearest: int = NEAREST, shared: int = SHARED, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """Per row: its key, ``n_links``, ``component_id`` (smallest key reachable) and ``kept``."""
    found = usable(rows, key, vector).where(F.exists("vector", lambda v: v != 0))
    marks = [F.xxhash64(F.lit(i), "vector").alias(f"mark{i}") for i in (1, 2)]
    found = common.stored(found.withColumn("dim", F.size("vector")).select("*", *marks), "vectors")
    commonest = found.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    found = found.where(F.col("dim") == (commonest["dim"] if commonest else 0))
    groups = found.groupBy("mark1", "mark2").agg(F.min("key").alias("node"), F.count("*").alias("copies"))
    groups = common.stored(groups, "vector-classes")
    members = common.stored(found.join(groups, ["mark1", "mark2"]), "vector-members")
    classes = members.where(F.col("key") == F.col("node")).dropDuplicates(["node", "mark1", "mark2"])
    classes = common.stored(classes.select("node", "copies", "vector"), "vector-nodes")
    n = classes.count()
    kind = common.kind(members, "node")

    size = max(1, min(n, most_pivots, max(16, 4 * math.isqrt(n))))
    chosen = classes.orderBy(F.xxhash64("node"), "node").limit(size).select("vector").toArrow()
    pivots = matrix(chosen.column("vector")) if n else np.zeros((1, 1))
    norm = np.sqrt((pivots * pivots).sum(axis=1, keepdims=True))
    nearest = min(nearest, size)
    index = common.stored(described(classes, pivots / np.maximum(norm, 1e-300), nearest, kind), "pivot-index")

    lists = index.select("node", "copies", "vector", "nearest", F.explode("nearest").alias("pivot"))
    sizes = index.select(F.explode("nearest").alias("pivot")).groupBy("pivot").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.hash("node"), F.col("parts"))
    unit = lambda other: F.struct(
        F.least(own, other).alias("i"), F.greatest(own, other).alias("j"),
        F.when(own == other, 2).when(own < other, 0).otherwise(1).alias("left"))
    dealt = lists.join(F.broadcast(sizes), "pivot")  # one row per pivot at most
    dealt = dealt.withColumn("u", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), unit)))
    dealt = dealt.select("pivot", "u.i", "u.j", "u.left", "node", "copies", "vector", "nearest")
    least_shared = min(shared, nearest)
    links = common.stored(dealt.groupBy("pivot", "i", "j").applyInArrow(
        lambda t: _search_block(t, threshold, least_shared), f"node {kind}, other {kind}, links bigint"), "vector-links")

    parts = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    totals = links.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = common.stored(groups.join(totals, "node", "left").join(parts, "node", "left").select(
        F.col("node").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component"),
        "vector-totals")
    linked = members.select("key", "node").join(nodes, F.col("node") == F.col("of")).select(
        "key", F.col("links").alias("n_links"), F.coalesce("component", "of").alias("component_id"))
    linked = linked.withColumn("kept", F.col("key") == F.col("component_id"))
    value = F.col(vector).cast("array<double>")
    finite = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    takes = F.coalesce(
        F.col(key).isNotNull() & finite & F.exists(value, lambda v: v != 0)
        & (F.size(value) == (commonest["dim"] if commonest else 0)), F.lit(False))
    alone = rows.where(~takes).select(
        F.col(key).alias("key"), F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"),
        F.lit(True).alias("kept"))
    return linked.unionByName(alone).withColumnRenamed("key", key)
