"""The pipeline, its registration, and that nothing else depends on the package."""

import pathlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trovelight.llm import common, components, minhash_dedup, mixing
from trovelight.llm.queries import QUERIES

ROOT = pathlib.Path(__file__).resolve().parents[2]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = common.stored(stage(spark, docs, ""), f"test-{name}")
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    assert counts[0] >= counts[1] == counts[2] > 0
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", None, None, 0)] * 2])
def test_stages_take_empty_tables_and_nulls(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, ""), f"test-{name}")
    assert docs.count() == 0


def test_mixed_documents_follow_the_mix(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (i % 7 + 1), None, f"s{i % 4}", 1) for i in range(200)] + [(3, "w w w w", None, "s3", 1)] * 2,
        "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    size = F.size(F.split(F.trim("text"), " "))
    want = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    assert all(abs(got[s] - want[s]) <= 7 for s in want)
    most = out.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
    assert most <= 3 * 2


def test_dedup_decides_per_row(spark):
    text = lambda seed: " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, 9000, 60))
    rows = [(1, text(1)), (1, text(1)), (1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(3).upper()),
            (None, text(1)), (None, text(1)), (4, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, None, f"s{n % 2}", 1) for n, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], (r["text"] or "").lower()) for r in minhash_dedup.keep_first(docs).collect()]
    want = [(1, text(1)), (2, text(2)), (3, text(3)), (None, text(1)), (None, text(1)), (4, ""), (4, ""), (4, "")]
    assert sorted(left, key=str) == sorted(want, key=str)
    once = docs.where("doc_id = 1")
    assert minhash_dedup.keep_first(once).count() == 1


def test_no_task_gathers_the_rows_of_one_document(spark):
    rows = [(7, "w w w", None, "a", 1)] * 3000 + [(i, f"w{i} w", None, "ab"[i % 2], 1) for i in range(100, 3100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed_documents(docs)
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "row_number" not in plan
    whole = F.filter("taking", lambda x: x["words"] * 2 >= F.col("size"))
    keyed = docs.withColumn("__row", F.struct("doc_id", F.xxhash64(*docs.columns).alias("hash")))
    want = {r["doc_id"]: r["n"] for r in mixing.mix(keyed, key="__row").groupBy("__row.doc_id").agg(
        F.sum(F.size(whole)).alias("n")).collect() if r["n"]}
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == want and want[7] > 0


def test_components_equal_a_local_search(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    pairs += [(5000, 5001 + i) for i in range(200)]
    label = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in range(400):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components.components(
        spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label


def test_registration():
    import __spark_entry__

    for n in range(1, 11):
        assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_package():
    for path in [*ROOT.glob("trovelight/**/*.py"), *ROOT.glob("checks/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"trovelight\.llm|import llm|corpus_pipeline", path.read_text()), path
