"""Merkle manifest of a table: content-addressed nodes, proofs by descent from the root.

Digests are lowercase hex SHA-256 (``sha2(..., 256)``), a node's input is its children's hex
digests concatenated. Rows are leaves; each group (here: a source) gets a ternary tree over
its leaves in a stated order, and the groups' roots ("subroots") make one more ternary tree,
whose top is the root. While more than one node is left at a level, every 3 consecutive
nodes (the last run: fewer, even one) become the digest of their concatenation; a lone node
is its tree's top as it is.

Method (content-addressed DAG descent):

1. every internal node is stored as a record ``digest -> children``, level by level, by a
   ``groupBy`` over ``idx div 3``; a hot group is many small groups of three, never one task;
2. a leaf's position is its rank; its base-3 digits, read from the top, name the child taken
   at each step down. Requests that share a path prefix share what they collect, so the
   descent runs once per node (one row per prefix), joining the frontier with the records of
   its level by (tree, idx): every key there is unique, the root included, so no join has a
   hot key whatever the shape of the data;
3. each step keeps the children *not* taken (a path segment); at the leaf the segments are
   reversed, bottom-up, which is the proof; folding a leaf with them gives back the root.

Defined cases: null fields are encoded as ``-``; rows with equal order keys (repeated rows)
are ordered further by their leaf digest, so equal rows are interchangeable and reruns agree;
a null group is one group, first in order; a null doc_id sorts first in its group; an empty
table gives no rows. Only the columns named are read, so other columns of any name are
ignored. Very long texts are hashed whole, in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import common

ARITY = 3


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Digest of the encoded values, concatenated."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def positions(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``_p`` (partition) and ``_pos``: its 0-based place in ``order``, stored.

    The sort deals contiguous ranges to partitions; a row's place is the count of rows in
    earlier partitions plus its index in its own. Only per-partition counts (one row per
    partition) are gathered and broadcast, so no group of equal keys meets in one task.
    """
    spark = rows.sparkSession
    ordered = rows.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    kept = common.stored(ordered, "merkle-order")
    counts = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the running sum is bounded by the partition count, not the data.
    before = counts.select(
        "_p", (F.sum("_n").over(_running("_p")) - F.col("_n")).alias("_before"))
    return (kept.join(F.broadcast(before), "_p")
            .withColumn("_pos", F.col("_before") + F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33))
            .drop("_m", "_before"))


def _running(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def height(n: int) -> int:
    """Levels above the leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def build(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Records per level and the tops of all trees.

    ``nodes``: ``tree``, ``n`` (nodes of its tree at this level), ``idx`` (0..n-1), ``digest``.
    Returns records of levels 1..``levels`` (``tree, idx, n, digest, children``, each stored)
    and tops (``tree, level, digest``).
    """
    records, tops = [], [nodes.where("n = 1").select("tree", F.lit(0).alias("level"), "digest")]
    current = nodes
    for level in range(1, levels + 1):
        grouped = (current.where("n > 1")
                   .groupBy("tree", F.expr(f"idx div {ARITY}").alias("_g"))
                   .agg(F.max("n").alias("_n"), F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("_kids")))
        step = grouped.select(
            "tree", F.col("_g").alias("idx"), F.expr(f"(_n + {ARITY - 1}) div {ARITY}").alias("n"),
            F.sha2(F.array_join(F.transform("_kids", lambda k: k["digest"]), ""), 256).alias("digest"),
            F.transform("_kids", lambda k: k["digest"]).alias("children"))
        current = common.stored(step, f"merkle-level{level}")
        records.append(current)
        tops.append(current.where("n = 1").select("tree", F.lit(level).alias("level"), "digest"))
    return records, reduce(DataFrame.unionByName, tops)


def descend(records: list[DataFrame], starts: DataFrame) -> DataFrame:
    """Paths from each tree's top down to every leaf.

    ``starts``: ``tree, level, path`` (segments collected above this tree) and any columns to
    carry. Returns ``tree, idx, path`` (+ carried) at level 0, ``path`` top-down: per step the
    digit taken and the children not taken, left to right.
    """
    carried = [c for c in starts.columns if c not in ("tree", "level", "path")]
    frontier = None
    for level in range(len(records), 0, -1):
        entering = starts.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), "path", *carried)
        frontier = entering if frontier is None else frontier.unionByName(entering)
        here = records[level - 1].select("tree", "idx", "children")
        joined = frontier.join(here, ["tree", "idx"])
        taken = joined.select("tree", "idx", "path", "children", *carried,
                              F.explode(F.sequence(F.lit(0), F.size("children") - 1)).alias("_digit"))
        frontier = common.stored(taken.select(
            "tree", (F.col("idx") * ARITY + F.col("_digit")).alias("idx"),
            F.concat("path", F.array(F.struct(
                F.col("_digit").alias("digit"),
                F.filter("children", lambda d, i: i != F.col("_digit")).alias("others")))).alias("path"),
            *carried), f"merkle-descent{level}")
    bottom = starts.where("level = 0").select("tree", F.lit(0).cast("long").alias("idx"), "path", *carried)
    return bottom if frontier is None else frontier.unionByName(bottom)


def fold(start: Column, upward: Column) -> Column:
    """The top recomputed from ``start`` and segments ordered bottom-up."""
    def step(acc, seg):
        kids = F.concat(F.slice(seg["others"], 1, seg["digit"]), F.array(acc),
                        F.slice(seg["others"], seg["digit"] + 1, ARITY))
        return F.sha2(F.array_join(kids, ""), 256)

    return F.aggregate(upward, start, step)


SEGMENT = "array<struct<digit:int,others:array<string>>>"


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """Leaf, subroot, root, proof and a refolded root per row of ``docs``.

    Leaves: digest of doc_id, source, lang, n_chars, text. Trees per ``source`` (null first,
    UTF-8 bytewise), leaves by doc_id (null first, then leaf digest); subroots by source give
    the root. ``tampered_text`` (an expression over ``text``, default: the text) gives a second
    leaf that is folded with the original siblings into ``folded_root``; ``verified`` says
    whether that equals ``root``. ``proof_sha256``: digest of all siblings' hex, level by level
    from the leaf up to the root, left to right within a level.
    """
    spark = docs.sparkSession
    tampered_text = F.col("text") if tampered_text is None else tampered_text
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = docs.select(
        F.col("doc_id"), F.col("source"), digest(*cols).alias("leaf"),
        digest(*cols[:4], tampered_text).alias("tampered"))
    placed = positions(leaves, F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"))

    # Per (partition, source): a partition holds one contiguous range, so these rows are few.
    pairs = placed.groupBy("_p", "source").agg(F.min("_pos").alias("_lo"), F.count(F.lit(1)).alias("_c"))
    groups = pairs.groupBy("source").agg(F.min("_lo").alias("first"), F.sum("_c").alias("n"))
    groups = positions(groups, F.col("first")).select("source", "first", "n", F.col("_pos").alias("tree"))
    groups = common.stored(groups, "merkle-groups")
    pairs = pairs.join(groups, pairs["source"].eqNullSafe(groups["source"])).select(
        "_p", pairs["source"].alias("_source"), "first", "n", "tree")
    on = (placed["_p"] == pairs["_p"]) & placed["source"].eqNullSafe(pairs["_source"])
    leaves = common.stored(placed.join(pairs, on).select(
        "doc_id", "leaf", "tampered", "tree", "n", (F.col("_pos") - F.col("first")).alias("idx")), "merkle-leaves")

    sizes = groups.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("s")).first()
    if sizes is None or sizes["n"] is None:
        empty = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return spark.createDataFrame([], empty)

    records, tops = build(leaves.select("tree", "n", "idx", F.col("leaf").alias("digest")), height(sizes["n"]))
    subroots = tops.withColumnRenamed("digest", "subroot")

    upper_nodes = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(sizes["s"]).cast("long").alias("n"),
                                  F.col("tree").alias("idx"), F.col("subroot").alias("digest"))
    upper_records, upper_top = build(upper_nodes, height(sizes["s"]))
    root = upper_top.first()["digest"]  # one row: the top of the one upper tree
    empty_path = F.from_json(F.lit("[]"), SEGMENT)
    upper_paths = descend(upper_records, upper_top.select("tree", "level", empty_path.alias("path")))

    starts = subroots.join(upper_paths.select(F.col("idx").alias("tree"), "path"), "tree")
    paths = descend(records, starts)
    rows = leaves.join(paths, ["tree", "idx"])
    upward = F.reverse("path")
    return rows.select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"),
        F.sha2(F.array_join(F.flatten(F.transform(upward, lambda s: s["others"])), ""), 256).alias("proof_sha256"),
        fold(F.col("tampered"), upward).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
