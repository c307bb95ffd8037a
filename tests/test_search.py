"""Top-k search against brute force, in both layouts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trovelight.operators import search

POINTS = "chunk_id string, language string, vector array<float>"
QUERIES = "query_id long, language string, vector array<float>"
LAYOUTS = {"one block": {}, "blocks": {"block_bytes": 8192}}


def brute(points, queries, k, threshold, metric):
    hits = []
    for qid, qlang, q in queries:
        q, ranked = np.float32(q).astype(float), []
        for cid, lang, v in points:
            if qlang and qlang != lang:
                continue
            v = np.float32(v).astype(float)
            if metric == "l2":
                ranked.append((((q - v) ** 2).sum(), cid))
                continue
            scale = np.sqrt((q * q).sum()) * np.sqrt((v * v).sum())
            score = (q * v).sum() / scale if scale else 0.0
            if score >= threshold:
                ranked.append((-score, cid))
        ranked = sorted((round(s, 9), c) for s, c in ranked)[:k]
        hits += [(qid, c, i + 1, round(abs(s) if metric == "l2" else -s, 6)) for i, (s, c) in enumerate(ranked)]
    return sorted(hits)


def run(spark, points, queries, k, threshold, metric, parts=3, **limits):
    p = spark.createDataFrame(points, POINTS).repartition(parts)
    q = spark.createDataFrame(queries, QUERIES)
    rows = search.best_hits(q, p, k, threshold, metric, **limits).collect()
    return sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 6) + 0.0) for r in rows)


def random_vectors(n, dim, seed):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32).tolist()


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_equals_brute_force(spark, layout, metric):
    langs = ["go", "c", "rust"]
    points = [(f"p{i:03d}", langs[i % 3], v) for i, v in enumerate(random_vectors(300, 8, 1))]
    asks = ["go", None, "", "c", "lua"]
    queries = [(i, asks[i % 5], v) for i, v in enumerate(random_vectors(40, 8, 2))]
    expected = brute(points, queries, 5, 0.3, metric)
    assert expected and run(spark, points, queries, 5, 0.3, metric, **LAYOUTS[layout]) == expected


@pytest.mark.parametrize("layout", LAYOUTS)
def test_many_equal_copies_rank_by_id(spark, layout):
    """A third of all points share one vector; the smallest ids win, from any partition."""
    hot = [1.0, 2.0, 3.0, 4.0]
    points = [(f"hot{(i * 7919) % 2000:05d}", "go", hot) for i in range(2000)]
    points += [(f"p{i}", "go", v) for i, v in enumerate(random_vectors(4000, 4, 3))]
    queries = [(1, "go", hot), (2, None, [-1.0, 0.0, 0.0, 1.0])]
    expected = brute(points, queries, 7, 0.65, "cosine")
    assert [h[1] for h in expected[:7]] == [f"hot{i:05d}" for i in range(7)]
    assert run(spark, points, queries, 7, 0.65, "cosine", parts=5, **LAYOUTS[layout]) == expected


@pytest.mark.parametrize("layout", LAYOUTS)
def test_zero_vectors_and_fewer_points_than_k(spark, layout):
    points = [("a", "go", [0.0, 0.0]), ("b", "go", [1.0, 0.0])]
    queries = [(1, None, [1.0, 0.0]), (2, None, [0.0, 0.0])]
    for threshold in (0.0, 0.5):
        assert run(spark, points, queries, 5, threshold, "cosine", **LAYOUTS[layout]) == brute(
            points, queries, 5, threshold, "cosine")


def test_threshold_is_inclusive(spark):
    points, queries = [("a", "go", [3.0, 4.0]), ("b", "go", [4.0, 3.0])], [(1, "go", [4.0, 3.0])]
    assert len(run(spark, points, queries, 5, 0.96, "cosine")) == 2
    assert len(run(spark, points, queries, 5, 0.97, "cosine")) == 1


@pytest.mark.parametrize("layout", LAYOUTS)
def test_empty_sides(spark, layout):
    points, queries = [("a", "go", [1.0, 0.0])], [(1, "go", [1.0, 0.0])]
    assert run(spark, [], queries, 5, 0.5, "cosine", **LAYOUTS[layout]) == []
    assert run(spark, points, [], 5, 0.5, "cosine", **LAYOUTS[layout]) == []


def test_search_returns_payload_of_hits(spark):
    """A prompt vector with a language gives hits; without a corpus there are none."""
    schema = POINTS + ", repo string, path string, function_name string, code string"
    points = spark.createDataFrame([("a", "python", [0.1, 0.2, 0.3], "r", "p", "f", "code")], schema)
    queries = spark.createDataFrame([(1, "python", [0.1, 0.2, 0.3])], QUERIES)
    rows = search.search(queries, points).collect()
    assert [(r["chunk_id"], r["rank"], r["code"]) for r in rows] == [("a", 1, "code")]
    assert search.search(queries, points.limit(0)).collect() == []


def test_dimension_mismatch_is_an_error(spark):
    with pytest.raises(PySparkException):
        run(spark, [("a", "go", [1.0, 0.0])], [(1, "go", [1.0, 0.0, 0.0])], 5, 0.5, "cosine")


def test_vectors_alone_reach_python_and_hits_are_broadcast(spark, tmp_path):
    schema = POINTS + ", repo string, path string, function_name string, code string"
    spark.createDataFrame([("a", "go", [1.0], "r", "p", "f", "c")], schema).write.parquet(str(tmp_path / "t"))
    points = spark.read.parquet(str(tmp_path / "t"))
    queries = spark.createDataFrame([(1, "go", [1.0])], QUERIES)
    plan = search.search(queries, points)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("vector" in s and "code" not in s for s in scans) == 1
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan


def test_points_are_never_moved(spark):
    queries = spark.createDataFrame([(i, None, [1.0, float(i)]) for i in range(50)], QUERIES)
    points = spark.createDataFrame([("a", "go", [1.0, 0.0])], POINTS)
    size = search.measure(queries)
    assert (size.rows, size.dim, size.bytes) == (50, 2, 50 * 1040)
    for limit, blocks in ((52_000, 1), (26_000, 2)):
        plan = search.best_hits(queries, points, block_bytes=limit)._jdf.queryExecution().executedPlan().toString()
        below = plan.split("== Initial Plan ==")[-1]
        assert below.count("MapInArrow") == blocks and "Exchange" not in below[below.index("MapInArrow"):]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("bad", [float("nan"), float("inf"), 1e38])
def test_odd_points_cost_no_other_its_place(spark, layout, metric, bad):
    points = [(f"p{i:02d}", "go", v) for i, v in enumerate(random_vectors(20, 4, 5))]
    queries = [(i, None, v) for i, v in enumerate(random_vectors(6, 4, 6))]
    odd = [("bad0", "go", [bad] * 4), ("bad1", "go", [bad, 0.0, 0.0, -bad])]
    expected = brute(points, queries, 5, -2.0, metric)
    got = run(spark, points + odd, queries, 5, -2.0, metric, parts=1, **LAYOUTS[layout])
    if bad == 1e38 and metric == "cosine":
        assert len(got) == 30  # finite, so it may rank
    else:
        assert got == expected
    lost = run(spark, points, queries + [(9, None, [float("nan")] * 4)], 5, -2.0, metric, **LAYOUTS[layout])
    assert lost == expected


def test_only_the_languages_asked_for_are_read(spark, tmp_path):
    schema = POINTS + ", repo string, path string, function_name string, code string"
    spark.createDataFrame([(f"p{x}", x, [1.0], "r", "p", "f", "c") for x in ("go", "c", "rust")], schema).write.partitionBy(
        "language").parquet(str(tmp_path / "t"))
    points = spark.read.schema(schema).parquet(str(tmp_path / "t"))
    few = spark.createDataFrame([(1, "go", [1.0]), (2, "c", [1.0])], QUERIES)
    every = few.union(spark.createDataFrame([(3, None, [1.0])], QUERIES))
    odd = few.union(spark.createDataFrame([(3, "cobol", [1.0])], QUERIES))
    assert search.measure(few).languages == ("c", "go")
    assert search.measure(every).languages == search.measure(odd).languages == search.measure(few.limit(0)).languages == ()
    found = search.search(few, points)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and all("PartitionFilters: [language" in line and "IN (c,go)" in line for line in scans)
    assert {r["chunk_id"] for r in found.collect()} == {"pgo", "pc"}
    assert search.search(every, points).filter("query_id = 3").count() == 3


def test_k_and_metric_are_checked(spark):
    q, p = spark.createDataFrame([], QUERIES), spark.createDataFrame([], POINTS)
    with pytest.raises(ValueError):
        search.best_hits(q, p, k=0)
    with pytest.raises(ValueError):
        search.best_hits(q, p, metric="dot")
    assert search.best_hits(q, p).filter(F.col("rank") < 1).count() == 0


def test_points_of_several_blocks_are_made_once(spark):
    made = F.udf(lambda v: v, "array<double>").asNondeterministic()
    queries = spark.createDataFrame([(i, None, [1.0, float(i)]) for i in range(40)], "query_id int, language string, vector array<double>")
    points = spark.createDataFrame([(f"p{i}", "go", [float(i), 1.0]) for i in range(9)], "chunk_id string, language string, vector array<double>")
    points = points.withColumn("vector", made("vector"))
    hits = search.best_hits(queries, points, 3, 0.0, block_bytes=4_000)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") > 1 and "EvalPython" not in plan
    one = search.best_hits(queries, points, 3, 0.0)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, one.collect()))


def test_cosines_closer_than_single_precision_rank_exactly():
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    points = base + rng.normal(size=(5_000, 64)) * 1e-6  # cosines differ in the twelfth place
    queries = base + rng.normal(size=(700, 64)) * 1e-6
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    ids = pa.array([f"{i:05d}" for i in range(len(points))])
    asked = search.QueryMatrix(pa.array(range(len(queries))), np.array([""] * len(queries), object), queries)
    best = search._TopK(asked, 5, None, "cosine")
    for begin in range(0, len(points), 2_500):
        best.add(ids[begin:begin + 2_500], np.array(["go"] * 2_500, object), points[begin:begin + 2_500])
    got = best.result(["q", "p", "s"]).to_pandas().sort_values(["q", "s", "p"], ascending=[True, False, True])
    q, p = unit(queries), unit(points)
    for i in range(0, len(queries), 50):
        scores = (p * q[i]).sum(axis=1)
        expected = np.lexsort((np.arange(len(p)), -scores))[:5]
        assert got[got["q"] == i]["p"].tolist() == [f"{x:05d}" for x in expected]
