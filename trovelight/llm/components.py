"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``links`` (a, b); a component is its smallest node.

    Each round points every node at its smallest neighbour or itself, follows the pointers to
    their ends, and renames the links by those ends; links within one end fall away. A star
    shrinks to a point in one round, a path to at most half. Minima are aggregated before
    the shuffle and joins are between stored tables, so that a node with very many links is
    split by adaptive execution.
    """
    links = common.stored(links.where("a <> b").select("a", "b").distinct(), "links")
    members = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("end"))
        ends = common.stored(ends, "pointers")
        while True:
            further = ends.join(ends.select(F.col("node").alias("end"), F.col("end").alias("next")), "end")
            further = common.stored(further.select("node", F.col("next").alias("end"), (
                F.col("next") != F.col("end")).alias("moved")), "pointers")
            moved = not further.where("moved").isEmpty()
            ends = further.drop("moved")
            if not moved:
                break
        pointed = lambda side: ends.select(F.col("node").alias(side), F.col("end").alias(f"{side}_end"))
        links = common.stored(
            links.join(pointed("a"), "a").join(pointed("b"), "b").where("a_end <> b_end").select(
                F.col("a_end").alias("a"), F.col("b_end").alias("b")).distinct(), "links")
        if members is None:
            members = ends.select("node", F.col("end").alias("component"))
        else:
            later = ends.select(F.col("node").alias("component"), "end")
            members = members.join(later, "component", "left").select(
                "node", F.coalesce("end", "component").alias("component"))
        members = common.stored(members, "members")
    if members is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members
