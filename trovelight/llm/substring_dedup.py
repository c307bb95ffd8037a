"""Substring dedup: paragraph MinHash banding, exact verification, clusters by components.

Paragraphs here are what texts are copied in: a line is cut before each capitalised word and
after each sentence mark, so a passage set into the middle of another text yields the same
paragraphs wherever it stands. Pieces under ``LEAST_WORDS`` words that follow each other are
one paragraph; what is still shorter is only filling.

Spelling says nothing of borders in lower case, titles, lists of names or scripts without
capitals, and a passage may begin inside a sentence. So runs of ``RUN`` words are units besides,
where content alone puts them: each whose hash is the smallest of ``AROUND`` runs in a row
(winnowing). Texts that share ``RUN + AROUND - 1`` words in a row choose the same run among
them; what they share of ``LEAST_PASSAGE + 2 * (AROUND - 1)`` = 51 words or more is always found.
Runs are compared word for word, may overlap, and are left out where paragraphs say the same.

1. Paragraphs that are equal word for word form a class. Each class has ``BANDS`` MinHashes
   of its five-word shingles, each a band of its own: a pair at similarity 0.8 shares none
   of four with probability 0.2**4 = 0.0016.
2. Classes that collide are tried as stars and, where a star leaves a bucket in several
   components, by a search of the whole bucket; links are confirmed by exact Jaccard.
3. Components of links are clusters. A cluster that more than one document holds is repeated
   text; its copy in the document of the smallest key stays.
4. Repeated paragraphs of a document that follow each other, with at most ``GAP`` words of
   filling between, form a passage; only passages of ``LEAST_PASSAGE`` words or more count.

Texts are read twice: the first time for numbers of paragraphs only; the second time a Bloom
filter of fixed size passes the paragraphs that collided, so that what is not repeated is
never shuffled. What the filter passes wrongly is dropped by the joins after it.

Null and empty texts have no paragraphs. Rows that share a key count as one document; rows
without a key take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common, shingles
from .components import components
from .minhash_dedup import crowded, linked

SHINGLE, BANDS = 5, 4
LEAST_WORDS, GAP, LEAST_PASSAGE = 6, 12, 25
RUN, AROUND = 12, 14
TOGETHER = 1 << 16  # characters of short texts that are worked on at a time
FILTER_BITS = 1 << 26  # 8 MB
PAGE_BITS = 1 << 15  # of one row of Spark's bitmap aggregate

_FACTORS = shingles.mixed(np.arange(101, 101 + BANDS, dtype=np.uint64)) | np.uint64(1)
_RUNS = np.uint64(0x5851F42D4C957F2D)  # keeps numbers of runs and of paragraphs apart
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".!?\"')"]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True


def _sliding(how, values: np.ndarray, width: int) -> np.ndarray:
    """``how`` over each ``width`` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = how(out[:-step], out[step:])
        done += step
    return out


class Paragraphs:
    """The paragraphs of texts: word ranges, bytes, and numbers that tell them apart.

    Short texts are worked on together, since an array step costs more than its few values. A
    line feed stands between two texts and begins a paragraph; no shingle or run that reaches
    over it is used. ``starts`` has each text's first word, and the number of words at the end.
    """

    def __init__(self, *texts: str):
        contents = [t.encode("utf-8", "replace") for t in texts]
        content = b"\n".join(contents)
        self.raw = raw = np.frombuffer(content, np.uint8)
        self.words, self.begins, self.ends = shingles.words_of(np.frombuffer(content.lower(), np.uint8))
        self.offsets = np.cumsum([0, *(len(c) + 1 for c in contents)])
        self.starts = np.searchsorted(self.begins, self.offsets)
        n = len(self.words)
        if not n:
            self.first = self.last = np.zeros(0, np.int64)
            return
        lead = raw[self.begins]
        second = raw[np.minimum(self.begins + 1, len(raw) - 1)]
        capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        tail, before = raw[self.ends - 1], raw[np.maximum(self.ends - 2, 0)]
        stop = _STOPS[tail] | (_MARKS[tail] & _STOPS[before])
        lines = np.zeros(n + 1, bool)
        lines[np.searchsorted(self.begins, np.flatnonzero(raw == 10))] = True
        lines[0] = True
        opens = capital | lines[:-1]
        opens[1:] |= stop[:-1]
        first = np.flatnonzero(opens)
        # short pieces of a line that follow each other make one paragraph
        short = np.diff(np.append(first, n)) < LEAST_WORDS
        first = first[~(short & np.append(False, short[:-1])) | lines[first]]
        last = np.append(first[1:], n)
        long = last - first >= LEAST_WORDS
        self.first, self.last = first[long], last[long]

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """Which text each word is in."""
        return np.searchsorted(self.starts[:-1], words, "right") - 1

    def numbers(self) -> np.ndarray:
        """A number for each paragraph's sequence of words."""
        return shingles.sequence_numbers(self.words, self.first, self.last)

    def shingles(self) -> np.ndarray:
        """The shingle that begins at each word, the last few words aside."""
        return shingles.windows(self.words, SHINGLE)

    def minima(self) -> np.ndarray:
        """MinHashes (paragraphs x bands); equal numbers of different bands stay apart."""
        least = np.empty((len(self.first), BANDS), np.uint64)
        if not len(least):
            return least
        own = self.shingles()
        bounds = np.empty(2 * len(self.first), np.int64)
        bounds[::2], bounds[1::2] = self.first, self.last - SHINGLE + 1
        values = np.empty(len(own) + 1, np.uint64)  # the last one only lets a paragraph end at the end
        for band, factor in enumerate(_FACTORS):
            np.multiply(own, factor, out=values[:-1])
            values[-1] = values[-2]
            least[:, band] = np.minimum.reduceat(values, bounds)[::2]
        return shingles.mixed(least + _FACTORS)

    def sets(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shingle sets of the paragraphs ``some`` and the sets' 16-bit images.

        Sizes and values of the sets, then of the images, one paragraph after the other.
        """
        sizes = self.last[some] - self.first[some] - SHINGLE + 1
        if not len(some):
            return sizes, np.zeros(0, np.uint64), sizes, np.zeros(0, np.uint16)
        own = np.repeat(np.arange(len(some)), sizes)
        at = np.arange(len(own)) + np.repeat(self.first[some] - np.cumsum(sizes) + sizes, sizes)
        values = self.shingles()[at]
        order = np.lexsort((values, own))
        values = values[order]  # ``own`` ascends already
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (values[1:] != values[:-1])
        own, values = own[new], values[new]
        image = np.sort((own << 16) | (values & np.uint64(0xFFFF)).astype(np.int64))
        image = image[np.append(True, image[1:] != image[:-1])]
        count = lambda x: np.bincount(x, minlength=len(some))
        return count(own), values, count(image >> 16), (image & 0xFFFF).astype(np.uint16)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First words and numbers of the runs that content chooses."""
        n = len(self.words) - RUN + 1
        if n < AROUND:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        numbers = shingles.mixed(shingles.run_numbers(self.words, RUN) + _RUNS)
        least = _sliding(np.minimum, numbers, AROUND)
        for begin in self.starts[1:-1].tolist():  # not what reaches into the next text
            least[max(0, begin - RUN - AROUND + 2):begin] = 0
        edge = np.zeros(AROUND - 1, np.uint64)
        chosen = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), AROUND) == numbers)
        return chosen, numbers[chosen]

    def code_points(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of word ranges in code points of their text."""
        count = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=count[1:])
        base = count[self.offsets[self.text_of(first)]]
        return count[self.begins[first]] - base, count[self.ends[last - 1]] - base


def together(texts: list[str]) -> Iterator[tuple[int, Paragraphs]]:
    """The texts' paragraphs, about ``TOGETHER`` characters at a time, with the first text's place."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > TOGETHER:
            yield begin, Paragraphs(*texts[begin:i])
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, Paragraphs(*texts[begin:])


def paragraph_numbers(docs: DataFrame, key: str) -> DataFrame:
    """(key, number, run, bands) of every paragraph of six words or more and every run chosen.

    Bands of runs are 0.
    """

    def start():
        def work(batch):
            own, number, run, bands = [], [], [], []
            for begin, found in together(common.texts(batch)):
                at, numbers = found.runs()
                text = found.text_of(at)
                order = np.lexsort((numbers, text))
                text, numbers = text[order], numbers[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (numbers[1:] != numbers[:-1])
                text, numbers = text[new], numbers[new]
                own += [begin + found.text_of(found.first), begin + text]
                number += [found.numbers(), numbers]
                bands += [found.minima(), np.zeros((len(numbers), BANDS), np.uint64)]
                run += [np.zeros(len(found.first), bool), np.ones(len(numbers), bool)]
            joined = lambda x, empty: np.concatenate([empty, *x])
            flat = joined(bands, np.zeros((0, BANDS), np.uint64)).view(np.int64)
            return [common.repeated(batch.column(0), joined(own, np.zeros(0, np.int64))),
                    joined(number, np.zeros(0, np.uint64)).view(np.int64), joined(run, np.zeros(0, bool)),
                    *(np.ascontiguousarray(flat[:, b]) for b in range(BANDS))]

        return work

    rows = docs.select(F.col(key).alias("key"), F.col("text")).where(F.col("key").isNotNull())
    ddl = ", ".join(f"b{b} bigint" for b in range(BANDS))
    return common.map_batches(rows, start, f"key {common.kind(docs, key)}, number bigint, run boolean, {ddl}")


def bit_filter(numbers: DataFrame) -> np.ndarray:
    """A Bloom filter of one hash: ``FILTER_BITS`` bits, built by Spark page by page."""
    at = F.pmod(F.col("number"), F.lit(FILTER_BITS)) + 1
    pages = numbers.select(F.bitmap_bucket_number(at).alias("page"), F.bitmap_bit_position(at).alias("bit"))
    bits = np.zeros(FILTER_BITS // 8 + PAGE_BITS // 8, np.uint8)
    for row in pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        begin = (row["page"] - 1) * PAGE_BITS // 8
        bits[begin:begin + PAGE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def flagged_paragraphs(docs: DataFrame, key: str, wanted: DataFrame, compared: DataFrame,
                       runs: DataFrame) -> DataFrame:
    """(key, number, start, end, place, words, run, set, image) of what the filters pass.

    ``wanted`` and ``runs`` have the numbers of paragraphs and of runs. Sets and images are null
    where ``compared``, the numbers to be compared, has no such number, and for runs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(map(bit_filter, (wanted, compared, runs))))

    def start():
        filters = shared.value

        def passed(numbers: np.ndarray, bits: np.ndarray) -> np.ndarray:
            at = numbers & (FILTER_BITS - 1)
            return (bits[at >> 3] >> (at & 7) & 1).astype(bool)

        def work(batch):
            parts: list[list[np.ndarray]] = [[] for _ in range(12)]
            for begin, found in together(common.texts(batch)):
                run, run_numbers = found.runs()
                run_numbers = run_numbers.view(np.int64)
                some = passed(run_numbers, filters[2])
                run, run_numbers = run[some], run_numbers[some]
                numbers = found.numbers().view(np.int64)
                hit = np.flatnonzero(passed(numbers, filters[0]))
                if not len(hit) and not len(run):
                    continue
                first, last = np.append(found.first[hit], run), np.append(found.last[hit], run + RUN)
                text = found.text_of(first)
                compared = np.zeros(len(first), bool)
                compared[:len(hit)] = passed(numbers[hit], filters[1])
                sizes, values, widths, images = found.sets(hit[compared[:len(hit)]])
                all_sizes, all_widths = np.zeros((2, len(first)), np.int64)
                all_sizes[compared], all_widths[compared] = sizes, 2 * widths
                for part, column in zip(parts, (
                        begin + text, np.append(numbers[hit], run_numbers), *found.code_points(first, last),
                        first - found.starts[text], last - first, np.arange(len(first)) >= len(hit),
                        compared, all_sizes, values.view(np.int64), all_widths, images)):
                    part.append(column)
            kinds = [np.int64] * 6 + [bool, bool, np.int64, np.int64, np.int64, np.uint16]
            own, *columns, compared, sizes, values, widths, images = (
                np.concatenate([np.zeros(0, k), *part]) for part, k in zip(parts, kinds))
            ends = lambda x: np.append(0, np.cumsum(x)).astype(np.int32)
            none = pa.array(~compared)
            sets = pa.ListArray.from_arrays(pa.array(ends(sizes)), pa.array(values), mask=none)
            present = pa.array(compared).buffers()[1] if len(compared) else None
            images = pa.Array.from_buffers(
                pa.binary(), len(compared), [present, pa.py_buffer(ends(widths)), pa.py_buffer(images)])
            return [common.repeated(batch.column(0), own), *map(pa.array, columns), sets, images]

        return work

    rows = docs.select(F.col(key).alias("key"), F.col("text")).where(F.col("key").isNotNull())
    return common.map_batches(
        rows, start, f"key {common.kind(docs, key)}, number bigint, start bigint, end bigint, place bigint, "
        "words bigint, run boolean, set array<bigint>, image binary")


def repeated_passages(docs: DataFrame, key: str = "doc_id", percent: int = 80,
                      least_passage: int = LEAST_PASSAGE) -> DataFrame:
    """Paragraphs of repeated passages: key, ``start``, ``end``, ``n_words``, ``cluster_id``,
    ``first_doc_id``, ``kept``, ``passage_start``, ``passage_end``, ``passage_words``.

    Runs beyond the paragraphs have such rows, too, which may overlap others. ``start`` and
    ``end`` are code points; ``cluster_id`` is the smallest number of a paragraph
    of the cluster; ``kept`` marks the copy in the document of the smallest key.
    """
    found = common.stored(paragraph_numbers(docs, key), "paragraphs")
    runs = found.where("run").groupBy("number").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    runs = common.stored(runs.where("low <> high").select("number"), "repeated-runs")
    found = found.where("not run")
    repeated = found.groupBy("number").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    repeated = repeated.where("low <> high").select("number")
    banded = found.select(F.col("number").alias("node"), F.explode(F.array(*(f"b{b}" for b in range(BANDS)))).alias("band"))
    several = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    several = common.stored(several.where("low <> high").select("band"), "colliding")
    buckets = crowded(banded.join(several, "band").distinct())
    nodes = common.stored(buckets.select(F.col("node").alias("number")).distinct(), "compared")
    wanted = common.stored(repeated.unionByName(nodes), "wanted")

    flagged = common.stored(flagged_paragraphs(docs, key, wanted, nodes, runs), "flagged")
    # one holder of each paragraph to be compared brings its set
    holder = flagged.where("set is not null").groupBy(F.col("number").alias("node")).agg(
        F.min(F.struct("key", "place")).alias("holder"))
    holder = common.stored(holder.join(nodes.withColumnRenamed("number", "node"), "node", "left_semi"), "holders")
    sets = flagged.join(holder, (F.col("number") == F.col("node")) & (F.struct("key", "place") == F.col("holder")))
    sets = common.stored(sets.select("node", "set", "image"), "paragraph-sets")
    clusters = components(linked(buckets, sets, percent)).withColumnRenamed("node", "number")

    placed = flagged.drop("set", "image").join(common.stored(clusters, "clusters"), "number", "left").withColumn(
        "cluster_id", F.coalesce("component", "number")).drop("component")
    placed = common.stored(placed, "placed")
    shared = placed.groupBy("cluster_id").agg(F.min("key").alias("first_doc_id"), F.max("key").alias("last"))
    shared = common.stored(shared.where(F.col("first_doc_id") != F.col("last")).drop("last"), "shared")
    units = placed.join(shared, "cluster_id")

    by_place = Window.partitionBy("key").orderBy("place", "run", "start", "number")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    # runs inside a stretch of paragraphs without a gap say nothing new
    own_end = F.when(~F.col("run"), F.col("place") + F.col("words"))
    opens = ~F.col("run") & (F.col("place") > F.coalesce(F.max(own_end).over(before), F.lit(-1)))
    units = units.withColumn("opens", opens.cast("int")).withColumn("stretch", F.sum("opens").over(by_place))
    stretch_end = F.max(own_end).over(Window.partitionBy("key", "stretch"))
    units = units.withColumn("inside", F.col("run") & (
        F.col("place") + F.col("words") <= F.coalesce(stretch_end, F.lit(-1)))).where("not inside")
    gap = F.col("place") - F.max(F.col("place") + F.col("words")).over(before)
    units = units.withColumn("opens", F.coalesce((gap > GAP).cast("int"), F.lit(1)))
    units = units.withColumn("passage", F.sum("opens").over(by_place))
    whole = Window.partitionBy("key", "passage")
    units = units.select(
        F.col("key").alias(key), "start", "end", F.col("words").alias("n_words"), "cluster_id", "first_doc_id",
        (F.col("key") == F.col("first_doc_id")).alias("kept"),
        F.min("start").over(whole).alias("passage_start"), F.max("end").over(whole).alias("passage_end"),
        (F.max(F.col("place") + F.col("words")).over(whole) - F.min("place").over(whole)).alias("passage_words"))
    return units.where(F.col("passage_words") >= least_passage)
