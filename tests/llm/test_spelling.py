"""Spelling variants against brute force: plain edit distance over all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trovelight.llm import spelling
from trovelight.llm.queries import op12_spelling_variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n int"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_counts(rows, min_length=7):
    found = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 31 == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= min_length and n >= 2}


def brute_variants(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v)) if near else None
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, None, n, len(near), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def spark_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    base = ["internationale", "understanding", "Ärgerlicher", "bibliothèque", "probablement", "environment"]
    rows, i = [], 0
    for word in base:
        for variant, copies in [(word, 400), (word[:3] + "x" + word[3:], 30), (word[:3] + "x" + word[4:], 3),
                                (word[:-1], 2), (word + "s", 35), (word[:3] + "x" + word[3:] + "s", 2)]:
            for _ in range(copies):
                rows.append((i, f"{variant} noise{int(rng.integers(0, 9))}", "en", "s", 1, "clash", 0))
                i += 1
    rows += [(None, "understanding understanding zzzzzzzz", None, None, None, None, None), (i, None, "x", "y", 0, None, None),
             (i + 1, "", "x", "y", 0, None, None), (i + 2, "q" * 5000 + " " + "q" * 5000 + " " + "q" * 4999 + "r", "x", "y", 0, None, None),
             (i + 3, "ÀÉÎÕÜàéîõü ÀÉÎÕÜàéîõü àÉÎÕÜàéîõü", "x", "y", 0, None, None), (i, "repeated rowwww repeated rowwww", "x", "y", 0, None, None),
             (i, "repeated rowwww repeated rowwww", "x", "y", 0, None, None)]
    return rows


def test_word_counts_equal_brute_force(spark):
    rows = corpus()
    got = {r["word"]: r["n"] for r in spelling.word_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_counts(rows)


def test_variants_equal_brute_force(spark):
    rows = corpus()
    counts = brute_counts(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = spark_variants(spelling.variants(spelling.word_counts(docs), ratio=10, min_length=7))
    assert got == brute_variants(counts)
    assert any(r[0] is not None and r[0] != r[1] for r in got.values())  # a chain of two forms


@pytest.mark.parametrize("chunk", [64, 2048])
def test_near_pairs_in_crowded_blocks(spark, monkeypatch, chunk):
    """Hundreds of words with one prefix: the block is dealt into chunk pairs when it is large."""
    monkeypatch.setattr(spelling, "LARGEST_CHUNK", chunk)
    rng = np.random.default_rng(3)
    words = sorted({"abcd" + "".join(rng.choice(list("xyzé"), int(rng.integers(3, 6)))) for _ in range(900)})
    got = {(r["word"], r["near"]) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    assert got == want and len(want) > 500


def test_empty_vocabulary(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_query_on_smallest_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = spark_variants(op12_spelling_variants(spark, "/root/testdata/sf0.001"))
    assert got == brute_variants(brute_counts(rows))
