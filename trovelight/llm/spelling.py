"""Spelling variants: words one edit apart, each pointed at a much commoner near word.

Near words differ by exactly one inserted, deleted or replaced code point (Levenshtein
distance 1). A word's *form* is its near word of largest count (ties: the smallest in
code-point order) if that count is at least ``ratio`` times its own, else none; its *root*
follows forms to the last. Counts grow ``ratio``-fold along a chain, so chains are short
(at most log_ratio of the largest count) and have no cycles.

Method (bit-sliced position index), per block of candidates:

* candidate blocks by pigeonhole: for a pair of lengths s and s or s+1, the edit lies in one
  half, so the pair shares its first ``s div 2`` code points or its last ``ceil(s/2)``. Every
  word posts those two keys for s = its length and s = its length - 1; pairs meet in a block.
  Small blocks of one length are put together into groups of about a chunk (more candidates
  cost work, never change results); a block larger than a chunk is dealt into chunks by a
  hash, and every (query chunk, candidate chunk) pair is one group: groups are bounded,
  whatever the size of a block;
* per group: bitsets over the candidates, one per (position, letter), packed 8 to a byte;
  for all queries of one length at once, word-parallel recurrences over the positions keep
  the exact-prefix set and three one-error sets (a replaced, an extra and a missing code
  point; the last two read the bitsets of the shifted positions). What is left at the end,
  by length, is the near set. Only found pairs leave the group.

Defined cases: a word is never near itself; repeated words are counted, not repeated; an
empty vocabulary gives no rows; words of any length are compared whole (chunks shrink as
words grow, so memory stays bounded).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common

#: Bits of the position index per group: a block's chunk holds at most INDEX_BITS // (longest word + 2)
#: words, between 64 and LARGEST_CHUNK.
INDEX_BITS = 1 << 20
LARGEST_CHUNK = 2048


def near_pairs(words: DataFrame, min_length: int = 1) -> DataFrame:
    """``word, near``: every ordered pair of distinct entries of ``words.word`` one edit apart.

    ``min_length``: the shortest word there can be, so that no block is made for shorter ones.
    """
    w = words.select(F.col("word").alias("w")).where(F.col("w").isNotNull()).distinct()
    w = w.withColumn("m", F.char_length("w"))
    keys = []
    for shift in (0, 1):  # the pair's shorter length is this word's, or one less
        t = F.col("m") - shift
        head, tail = F.expr(f"(m - {shift}) div 2"), F.expr(f"(m - {shift}) - (m - {shift}) div 2")
        keys.append(F.when(t >= min_length, F.concat(F.lit("P"), t.cast("string"), F.lit(":"),
                                                      F.col("w").substr(F.lit(1), head))))
        keys.append(F.when(t >= min_length, F.concat(F.lit("S"), t.cast("string"), F.lit(":"),
                                                      F.col("w").substr(F.col("m") - tail + 1, tail))))
    posted = common.stored(w.select("w", "m", F.explode(F.array(*keys)).alias("key"))
                           .where(F.col("key").isNotNull())
                           .withColumn("t", F.regexp_extract("key", "^.(\\d+):", 1).cast("int")), "spelling-posted")
    # A block's words are t or t+1 long; its groups hold at most ``cap`` words per side.
    cap = F.greatest(F.lit(64), F.least(F.lit(LARGEST_CHUNK), F.expr(f"{INDEX_BITS} div (t + 3)")))
    blocks = posted.groupBy("key", "t").agg(F.count(F.lit(1)).alias("size")).withColumn("cap", cap)
    # Small blocks of one length share groups (extra candidates cost work, never results);
    # a large block is dealt into chunks of its own.
    small = blocks.where("size <= cap").groupBy("t").agg(F.ceil(F.sum("size") / F.first("cap")).alias("bins"))
    blocks = blocks.join(small, "t", "left").select(
        "key",
        F.when(F.col("size") <= F.col("cap"), F.concat(F.lit("#"), F.col("t").cast("string"), F.lit(":"),
                                                       F.pmod(F.xxhash64("key"), F.col("bins")).cast("string")))
        .otherwise(F.col("key")).alias("group"),
        F.when(F.col("size") <= F.col("cap"), F.lit(1)).otherwise(F.ceil(F.col("size") / F.col("cap"))).cast("int").alias("c"))
    dealt = posted.join(blocks, "key").withColumn("chunk", F.pmod(F.xxhash64("w"), F.col("c")).cast("int"))
    # A word is a query of its chunk against every candidate chunk, and a candidate the other way.
    others = F.sequence(F.lit(0), F.col("c") - 1)
    queries = dealt.select("group", F.col("chunk").alias("cq"), F.explode(others).alias("cw"), "w", F.lit(True).alias("q"))
    cands = dealt.select("group", F.explode(others).alias("cq"), F.col("chunk").alias("cw"), "w", F.lit(False).alias("q"))
    found = queries.unionByName(cands).groupBy("group", "cq", "cw").applyInPandas(_near_in_group, "word string, near string")
    return found.distinct()


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, -1 past a word's end."""
    out = np.full((len(words), width), -1, dtype=np.int32)
    for i, word in enumerate(words):
        out[i, :len(word)] = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)
    return out


def _near_in_group(group: pd.DataFrame) -> pd.DataFrame:
    is_query = group["q"].to_numpy()
    cands = list(dict.fromkeys(group.loc[~is_query, "w"]))
    queries = list(dict.fromkeys(group.loc[is_query, "w"]))
    if not cands or not queries:
        return _pairs([], [])
    lengths = np.array([len(c) for c in cands])
    width = int(lengths.max()) + 1
    ccodes = _codes(cands, width)
    letters, dense = np.unique(ccodes, return_inverse=True)
    dense = dense.reshape(ccodes.shape)
    # index[i][a]: packed bitset of candidates whose code point at i is letters[a]; the last row
    # (letters absent from all candidates) stays empty.
    index = np.zeros((width, len(letters) + 1, (len(cands) + 7) // 8), dtype=np.uint8)
    for i in range(width):
        index[i, :len(letters)] = np.packbits(dense[:, i][None, :] == np.arange(len(letters))[:, None], axis=1)
    by_length = {n: np.packbits(lengths == n) for n in np.unique(lengths)}
    empty = np.zeros((len(cands) + 7) // 8, dtype=np.uint8)
    words, nears = [], []
    qlen = np.array([len(q) for q in queries])
    for m in np.unique(qlen):
        chosen = [q for q, n in zip(queries, qlen) if n == m]
        qcodes = _codes(chosen, int(m))
        slot = np.searchsorted(letters, qcodes)
        slot = np.where((slot < len(letters)) & (letters[np.minimum(slot, len(letters) - 1)] == qcodes), slot, len(letters))

        def bit(i, j):  # candidates with the query's j-th code point at position i
            if i < 0 or i >= width:
                return np.zeros((len(chosen), empty.size), dtype=np.uint8)
            return index[i, slot[:, j]]

        ones = np.full((len(chosen), empty.size), 0xFF, dtype=np.uint8)
        exact, replaced, extra, missing = ones, np.zeros_like(ones), ones.copy(), None
        for i in range(1, int(m) + 1):
            here = bit(i - 1, i - 1)
            before = exact
            replaced = (replaced & here) | (before & ~here)
            exact = before & here
            extra = (extra & bit(i, i - 1)) | exact
            missing = before.copy() if i == 1 else (missing & bit(i - 2, i - 1)) | before
        near = (replaced & by_length.get(m, empty)) | (extra & by_length.get(m + 1, empty)) \
            | (missing & by_length.get(m - 1, empty))
        qi, ci = np.nonzero(np.unpackbits(near, axis=1, count=len(cands)))
        words.extend(chosen[k] for k in qi)
        nears.extend(cands[k] for k in ci)
    return _pairs(words, nears)


def _pairs(words: list[str], nears: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series(words, dtype=object), "near": pd.Series(nears, dtype=object)})


def variants(counts: DataFrame, ratio: int = 10, min_length: int = 1) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``counts`` (``word, n``).

    ``counts`` holds each word once; words of null ``word`` are left out.
    """
    counts = common.stored(counts.select("word", F.col("n").cast("long").alias("n")).where(F.col("word").isNotNull()),
                           "spelling-counts")
    pairs = near_pairs(counts, min_length)
    other = counts.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    linked = pairs.join(other, "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("near"))).alias("best"))
    rows = counts.join(linked, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.neg") >= ratio * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.neg") >= ratio * F.col("n"), -F.col("best.neg")).alias("form_n"))
    rows = common.stored(rows, "spelling-forms")
    # Follow forms: each step multiplies the count by ratio, so the chain has a known bound.
    top = rows.agg(F.max("n"), F.min("n")).first()
    steps, reach = 0, 1
    if top[0] is not None:
        while reach * ratio <= top[0] / max(top[1], 1):
            steps, reach = steps + 1, reach * ratio
    links = rows.select(F.col("word").alias("_at"), F.col("form").alias("_next"))
    walk = rows.withColumn("root", F.coalesce("form", "word"))
    for step in range(steps):
        walk = walk.join(links, walk["root"] == links["_at"], "left").select(
            *[c for c in walk.columns if c != "root"], F.coalesce("_next", "root").alias("root"))
        walk = common.stored(walk, f"spelling-root{step}")
    return walk.select("word", "form", "root", "n", "n_near", "form_n")


#: Letters of a word: ASCII and Latin-1 letters (fixed by the contract), of which only A-Z are lower-cased.
LETTERS = "[A-Za-z\u00C0-\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, drop_every: int = 31) -> DataFrame:
    """``word, n`` over whole texts: runs of letters, A-Z lower-cased, a planted misspelling.

    Where ``drop_every`` divides h, the unsigned CRC-32 of ``<doc_id>:<run>``, the run loses its
    code point at ``h mod length``; a null doc_id plants nothing. Words of at least
    ``min_length`` code points that occur at least ``min_count`` times are kept.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({LETTERS})"), 1)).alias("r"))
    runs = runs.select("doc_id", F.translate("r", UPPER, LOWER).alias("r"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("r")))
    cut = (h % F.char_length("r")).cast("int")
    word = F.when(h % drop_every == 0, F.concat(F.col("r").substr(F.lit(1), cut),
                                                F.col("r").substr(cut + 2, F.char_length("r")))).otherwise(F.col("r"))
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.char_length("word") >= min_length) & (F.col("n") >= min_count))
