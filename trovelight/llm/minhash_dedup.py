"""Near-duplicate documents by one-permutation MinHash with star-shaped candidate edges.

1. A document is its set of distinct word shingles. Documents with equal sets form a class;
   only its smallest key goes on.
2. One hash of each shingle fills all bins at once; empty bins are densified. Runs of bins
   are bands; documents that agree in a band share its bucket. A pair at similarity 0.8
   shares none of the 24 buckets with probability (1 - 0.8**4)**24 = 3e-6.
3. In each bucket every member is tried against one hub only, the member with most
   company over all its buckets, so a bucket of n yields n - 1 candidates, not n * n / 2.
   Candidates are confirmed on the full sets.
4. A star can miss a link between two members that are not both linked to the hub. Buckets
   whose members are not all in one component are therefore searched whole, in blocks: a
   16-bit image of each set bounds its overlap with every other from above, and only pairs of
   different components whose bound reaches the threshold are confirmed on the full sets.
   No link inside a bucket is lost, and rows are emitted only for pairs that may be links.

Sets travel only for documents that share a bucket. Null and empty texts have no shingles
and link with nothing. Rows that share a key count as one document that has all their links;
rows with a null key link with nothing and stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common, shingles
from .components import components
from .mixing import ranked

ROWS, BANDS = 4, 24
BLOCK = 2_048


def sketches(docs: DataFrame, key: str, k: int) -> DataFrame:
    """Per document: set size, two numbers that tell its set, and its band keys."""

    def start():
        probes = shingles.probe_table(ROWS * BANDS)

        def work(batch):
            sizes, one, two, keys = [], [], [], []
            for text in common.texts(batch):
                found = shingles.shingle_set(shingles.word_numbers(text), k)
                sizes.append(len(found))
                one.append(found.sum(dtype=np.uint64))
                two.append(shingles.mixed(found).sum(dtype=np.uint64))
                keys.append(shingles.band_keys(shingles.signature(found, probes), ROWS).view(np.int64).tolist()
                            if len(found) else None)
            as_long = lambda x: np.array(x, np.uint64).view(np.int64)
            return [batch.column(0), sizes, as_long(one), as_long(two), keys]

        return work

    rows = docs.select(F.col(key).alias("key"), F.col("text"))
    return common.map_batches(
        rows, start, f"key {common.kind(docs, key)}, n bigint, one bigint, two bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, key: str, k: int) -> DataFrame:
    """Per document: its key, its whole set, and the set's 16-bit image."""

    def start():
        def work(batch):
            found = [shingles.shingle_set(shingles.word_numbers(t), k) for t in common.texts(batch)]
            return [batch.column(0), [f.view(np.int64) for f in found],
                    [np.unique(f.astype(np.uint16)).tobytes() for f in found]]

        return work

    rows = docs.select(F.col(key).alias("node"), F.col("text"))
    return common.map_batches(rows, start, f"node {common.kind(docs, key)}, set array<bigint>, image binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have at least ``percent`` per cent in common."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common_size = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - common_size
    return both.where(100 * common_size >= percent * union).select("a", "b").distinct()


def ordered_pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.where(F.col(x) != F.col(y)).select(
        F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _search_block(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of different components in one block whose overlap may reach the threshold."""
    first = table.column("left").to_numpy()
    nodes, parts = table.column("node").to_numpy(), table.column("component").to_numpy()
    sizes = table.column("n").to_numpy()
    images = [np.frombuffer(x, np.uint16) for x in table.column("image").to_pylist()]
    lengths = np.fromiter(map(len, images), np.int64, len(images))
    flat, begins = np.concatenate(images), np.cumsum(lengths) - lengths
    slack = sizes - lengths  # shingles that share an image with another of their set
    mark = np.zeros(1 << 16, np.int64)
    a, b = [], []
    order = np.argsort(sizes, kind="stable")
    # the side that a row is on: 0 and 1 meet each other, 2 is a block that meets itself
    for i in order.tolist():
        meets = (parts != parts[i]) & (nodes > nodes[i]) & ((first != first[i]) | (first == 2))
        meets &= (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if not meets.any():
            continue
        mark[images[i]] = 1
        shared = np.add.reduceat(mark[flat], begins)
        mark[images[i]] = 0
        bound = np.minimum(shared + slack, shared + slack[i])
        hit = np.flatnonzero(meets & ((100 + percent) * bound >= percent * (sizes + sizes[i])))
        a += [nodes[i]] * len(hit)
        b += nodes[hit].tolist()
    return pa.table({"a": pa.array(a, table.schema.field("node").type),
                     "b": pa.array(b, table.schema.field("node").type)})


def missed_pairs(buckets: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket and different components that may be links after all."""
    parts = components(links).withColumnRenamed("component", "found")
    members = common.stored(buckets.join(parts, "node", "left").select(
        "band", "node", F.coalesce("found", "node").alias("component")), "members")
    mixed = members.groupBy("band").agg(
        F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    # of two members the star has tried the only pair there is
    mixed = common.stored(mixed.where("low <> high and m > 2").select("band", "m"), "mixed-buckets")
    # a bucket of more than one block: each block meets every other, and itself
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.hash("node"), blocks)
    unit = lambda other: F.struct(
        F.least(own, other).alias("i"), F.greatest(own, other).alias("j"),
        F.when(own == other, 2).when(own < other, 0).otherwise(1).alias("left"))
    rows = members.join(mixed, "band").join(
        sets.select("node", F.size("set").cast("long").alias("n"), "image"), "node")
    rows = rows.withColumn("u", F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), unit)))
    rows = rows.select("band", "u.i", "u.j", "u.left", "node", "component", "n", "image")
    kind = common.kind(buckets, "node")
    return rows.groupBy("band", "i", "j").applyInArrow(
        lambda t: _search_block(t, percent), f"a {kind}, b {kind}").distinct()


def crowded(banded: DataFrame) -> DataFrame:
    """(band, node, m): the rows (node, band) of the bands that hold ``m`` nodes, two or more."""
    several = common.stored(banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "crowded")
    return common.stored(banded.join(several, "band").select("band", "node", "m"), "buckets")


def linked(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what shares a bucket and ``percent`` per cent of its set.

    ``buckets`` as ``crowded`` gives them; ``sets`` has (node, set, image) for their nodes. Links
    that would only join what others already connect may be left out.
    """
    company = common.stored(buckets.groupBy("node").agg(F.sum("m").alias("company")), "company")
    hubs = buckets.join(company, "node").groupBy("band").agg(F.max_by("node", "company").alias("hub"))
    stars = common.stored(ordered_pairs(buckets.join(common.stored(hubs, "hubs"), "band"), "node", "hub"), "stars")
    links = common.stored(confirmed(stars, sets, percent), "links")
    missed = common.stored(missed_pairs(buckets.select("band", "node"), sets, links, percent), "missed")
    return common.stored(links.unionByName(confirmed(missed, sets, percent)), "all-links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: its key, ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked if their sets of ``k``-word shingles have at least ``percent``
    per cent of their union in common; a component is named by its smallest key, and ``kept``
    is that document (and each without a key).
    """
    rows = common.stored(sketches(docs, key, k), "sketches")
    classes = rows.where((F.col("n") > 0) & F.col("key").isNotNull()).groupBy("one", "two").agg(
        F.min("key").alias("node"))
    classes = common.stored(classes, "classes")
    own = F.when(F.col("key").isNotNull(), F.col("node"))
    rows = common.stored(rows.join(classes, ["one", "two"], "left").select(
        "key", "n", own.alias("node"), F.when(F.col("key") == F.col("node"), F.col("bands")).alias("bands")), "documents")

    buckets = crowded(rows.where(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("band")))
    wanted = common.stored(buckets.select("node").distinct(), "candidates")
    kept_docs = docs.select(key, "text").join(wanted.select(F.col("node").alias(key)), key, "left_semi")
    copy = Window.partitionBy(key, F.xxhash64("text")).orderBy(key)
    kept_docs = kept_docs.withColumn("__n", F.row_number().over(copy)).where("__n = 1")
    sets = common.stored(shingle_sets(kept_docs, key, k), "shingle-sets")
    found = components(linked(buckets, sets, percent)).withColumnRenamed("component", "found")
    component = F.coalesce("found", "node", "key")
    return rows.join(found, "node", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__hash`` of the text; of rows alike in key and text the smallest stays.

    Rows without a key or a word all stay.
    """
    told = docs.withColumn("__hash", F.xxhash64("text"))
    same = told.where(F.col("doc_id").isNotNull() & F.col("text").rlike(common.WORD)).groupBy("doc_id", "__hash").count()
    same = common.stored(same.where("count > 1").drop("count"), "same-rows")
    if same.isEmpty():
        return told
    # aggregated before the shuffle, so a task sends one row of each such document at most
    least = F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("__one")
    one = told.join(same, ["doc_id", "__hash"], "left_semi").groupBy("doc_id", "__hash").agg(least)
    rest = told.join(same, ["doc_id", "__hash"], "left_anti").select(*told.columns)
    return common.stored(rest.unionByName(one.select("__one.*", "__hash")), "single-rows")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest key.

    Texts that share a key are decided each by itself, whichever others of the key are copies.
    """
    told = one_of_each(docs)
    several = told.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("__hash").alias("low"), F.max("__hash").alias("high"))
    several = common.stored(several.where("low <> high").select("doc_id"), "keys-of-several")
    if several.isEmpty():
        gone = common.stored(near_duplicates(told, k=k, percent=percent).where("not kept").select(
            "doc_id").distinct(), "duplicates")
        return told.join(gone, "doc_id", "left_anti").select(*docs.columns)
    names = told.select("doc_id", "__hash").where(F.col("doc_id").isNotNull()).distinct()
    names = common.stored(ranked(names, F.col("doc_id"), F.col("__hash"), name="__name"), "names")
    named = told.join(names, ["doc_id", "__hash"], "left").select(*told.columns, "__name")
    named = common.stored(named, "named")
    gone = common.stored(near_duplicates(named, "__name", k, percent).where("not kept").select(
        "__name").distinct(), "duplicates")
    return named.join(gone, "__name", "left_anti").select(*docs.columns)
