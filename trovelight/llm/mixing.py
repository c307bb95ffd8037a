"""Mixing sources to target weights along a time-varying curriculum.

Every source has a schedule: its weight at given times between 0 and 1, straight lines between
them. The integral of a schedule is the source's share of the mix; shares that ask for more
than ``passes`` times a source's words stop there and the excess goes to the others by weight.
A source's cumulative demand follows its schedule from 0 to its target, so the word at which a
document starts in its source has one time at which it is due. Documents are put in order by
that time, each as often as the mix passes over it.

Within a source documents stand in the order of a hash of their key. Running totals are taken
within ranges of that order and moved by the totals of the ranges before, so no source, however
large, is handled by one task. Rows of one key and size are told apart by a number of their own,
so ranges part them, too; they are interchangeable, and all sums are of integers: reruns agree.

Null text counts as empty; null sources form one source, last in order. Documents without
words take no part (``taken`` 0). The last pass of a source may end inside a document, which
is then taken in part, its first words: ``taken`` of a source is its target to the nearest word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

PASSES = 3
SEED = 2026


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``rows`` numbered from 0 in ``order``, without bringing them together in one task."""
    dealt = common.stored(
        rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(starts), "__part").withColumn(
        name, F.col("__before") + place).drop("__part", "__before")


def steady(sources: DataFrame) -> DataFrame:
    """Schedules for ``sources``: by code point, null last, weights 1, 2, 3, repeating.

    The first of two sources fades (one and a half times its weight down to half), the next
    one grows; both integrate to their weight.
    """
    numbered = ranked(sources.select("source").distinct(), F.col("source").asc_nulls_last())
    weight = (F.col("rank") % 3 + 1).cast("double")
    first = F.when(F.col("rank") % 2 == 0, 1.5).otherwise(0.5)
    knot = lambda at, by: F.struct(F.lit(at).alias("at"), (weight * by).alias("weight"))
    return numbered.select("source", F.array(knot(0.0, first), knot(1.0, 2 - first)).alias("knots"))


def integrated(schedules: DataFrame) -> DataFrame:
    """Adds ``weight``, the integral, and ``legs``: straight pieces with the integral before each."""
    leg = lambda i: F.struct(
        F.col("knots")[i - 1]["at"].alias("at"), F.col("knots")[i - 1]["weight"].alias("weight"),
        ((F.col("knots")[i]["weight"] - F.col("knots")[i - 1]["weight"])
         / (F.col("knots")[i]["at"] - F.col("knots")[i - 1]["at"])).alias("slope"),
        ((F.col("knots")[i]["at"] - F.col("knots")[i - 1]["at"])
         * (F.col("knots")[i]["weight"] + F.col("knots")[i - 1]["weight"]) / 2).alias("area"))
    legs = F.transform(F.sequence(F.lit(1), F.size("knots") - 1), leg)
    area = lambda upto: F.aggregate(upto, F.lit(0.0), lambda s, x: s + x["area"])
    before = F.transform("legs", lambda x, i: x.withField("before", area(F.slice("legs", F.lit(1), i))))
    return schedules.withColumn("legs", legs).select(
        "source", area(F.col("legs")).alias("weight"), before.alias("legs"))


def due(legs: Column, area: Column) -> Column:
    """The time at which a schedule's integral reaches ``area``: a root of its quadratic."""
    leg = F.element_at(F.filter(legs, lambda x: (x["before"] <= area) & (x["area"] > 0)), -1)
    rest = area - leg["before"]
    root = F.sqrt(F.greatest(F.lit(0.0), leg["weight"] * leg["weight"] + 2 * leg["slope"] * rest))
    return F.when(rest <= 0, leg["at"]).otherwise(leg["at"] + 2 * rest / (leg["weight"] + root))


def with_targets(sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """Adds ``target`` to ``sources`` (``source_size``, ``weight``): shares by weight, capped.

    A source is at its cap exactly if its cap is under the water level times its weight. The
    level rises as capped sources give back their excess, one aggregation over the sources at
    a time, until it stands.
    """
    sources = common.stored(sources, "mix-sources")
    cap = F.col("source_size") * passes
    level = 0.0
    while True:
        capped = F.col("weight") * level > cap
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, cap)).alias("given"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            break
        rising = max(0, (row["all"] or 0) - (row["given"] or 0)) / row["weight"]
        if rising <= level:
            break
        level = rising
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def mix(docs: DataFrame, schedules: DataFrame | None = None, key: str = "doc_id", passes: int = PASSES) -> DataFrame:
    """One row per row of ``docs``: what the mix takes of it, in order of the first time it is due.

    Columns: the key, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``position``
    (of the first pass, null if none) and ``taking``: pass, position and words of each pass.
    ``schedules`` has ``source`` and ``knots`` (array of ``at``, ``weight``), from 0 to 1.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    sized = common.stored(docs.select(F.col(key).alias("key"), "source", size.alias("size")), "mix-sizes")
    sized = sized.withColumn("order", F.xxhash64(F.lit(SEED), "key")).withColumn("copy", F.monotonically_increasing_id())
    sized = common.stored(sized.repartitionByRange("source", "order", "key", "size", "copy").withColumn(
        "part", F.spark_partition_id()), "mix-parts")

    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plans = integrated(steady(sizes) if schedules is None else schedules)
    sources = with_targets(sizes.join(plans, sizes["source"].eqNullSafe(plans["source"]), "left").select(
        sizes["source"], "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"), "legs"), passes)

    ranges = sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    sources = sources.withColumnRenamed("source", "of")
    ranges = ranges.join(sources, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("of"), F.col("part").alias("in"), "before", "source_size", "weight", "target", "legs")
    ranges = common.stored(ranges, "mix-ranges")

    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))
    within = Window.partitionBy("source", "part").orderBy("order", "key", "size", "copy").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = sized.join(ranges, same).withColumn(
        "start", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))

    words = F.round("target").cast("long")
    begin = lambda n: n * F.col("source_size") + F.col("start")
    one = lambda n: F.struct(
        n.alias("pass"),
        due(F.col("legs"), begin(n) / F.col("target") * F.col("weight")).alias("position"),
        F.greatest(F.lit(0), F.least("size", words - begin(n))).alias("words"))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(passes - 1).cast("long")), one)
    taking = F.filter(F.when(F.col("target") > 0, each).otherwise(F.array().cast(
        "array<struct<pass:bigint,position:double,words:bigint>>")), lambda x: x["words"] > 0)
    placed = placed.withColumn("taking", taking)
    return placed.select(
        F.col("key").alias(key), "source", "size", "source_size", "target",
        F.aggregate("taking", F.lit(0).cast("long"), lambda s, x: s + x["words"]).alias("taken"),
        F.try_element_at("taking", F.lit(1))["position"].alias("position"), "taking", "order",
    ).orderBy(F.col("position").asc_nulls_last(), "order").drop("order")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order, one row per pass, columns as they are.

    Only whole texts are handed on: a pass that takes at least half of a document takes all of
    it, any other leaves it out, so a source is within one document of its target. A document
    is told by its key and a hash of its row. Of rows alike in all columns one is joined to the
    positions of all, which stay rows: no task gathers those of one document.
    """
    row = F.struct("doc_id", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("hash"))
    keyed = docs.withColumn("__row", row)
    whole = F.filter("taking", lambda x: x["words"] * 2 >= F.col("size"))
    passes = mix(keyed, key="__row").select("__row", F.explode(F.transform(whole, lambda x: x["position"])).alias("__at"))
    passes = common.stored(passes, "mix-order")
    alike = common.stored(keyed.groupBy("__row").count().where("count > 1").select("__row"), "mix-alike")
    # aggregated before the shuffle, so a task sends one row of each such document at most
    one = keyed.join(alike, "__row", "left_semi").groupBy("__row").agg(
        F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("__one"))
    ordered = keyed.join(alike, "__row", "left_anti").unionByName(one.select("__row", "__one.*")).join(passes, "__row")
    return ordered.orderBy("__at", "doc_id", "__row").select(*docs.columns)
