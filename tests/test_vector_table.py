import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trovelight.operators import upsert
from trovelight.sources.vector_table import VectorTable

POINT = "chunk_id string, language string, repo string, path string, function_name string, code string, vector array<float>"


def points(spark, *rows):
    return spark.createDataFrame(
        [(i, lang, "r", path, "f", code, [1.0, float(len(code))]) for i, lang, path, code in rows], POINT)


def contents(table):
    return {r["chunk_id"]: r["code"] for r in table.read().collect()}


def test_upsert_life_cycle(spark, tmp_path):
    table = VectorTable.create(spark, str(tmp_path / "t"), 2, encoder="e")
    assert contents(table) == {} and table.check_count(0) == 0
    first = table.load(points(spark, ("a", "go", "p1", "1"), ("a", "go", "p2", "2"), ("b", "c", "p1", "b")), "s", 0)
    assert (first.rows, first.replaced, first.skipped) == (2, 1, False)
    assert contents(table) == {"a": "2", "b": "b"}
    table.load(points(spark, ("b", "c", "p1", "newer"), ("c", "go", "p1", "c")), "s", 1)
    expected = {"a": "2", "b": "newer", "c": "c"}
    assert contents(table) == expected
    assert table.load(points(spark, ("b", "c", "p1", "replayed")), "s", 1).skipped
    assert table.compact() == 3 and contents(table) == expected
    assert table.load(points(spark, ("b", "c", "p1", "replayed")), "s", 1).skipped
    with pytest.raises(ValueError):
        table.load(points(spark, ("b", "c", "p1", "older")), "s", 0)
    table.load(points(spark, ("a", "go", "p9", "again")))
    assert contents(table) == {**expected, "a": "again"} and table.check_count(3) == 3
    reopened = VectorTable(spark, str(tmp_path / "t"))
    assert contents(reopened) == contents(table) and reopened.encoder == "e"
    with pytest.raises(ValueError):
        table.check_count(4)


def test_sources_do_not_hide_each_other(spark, tmp_path):
    """Batch numbers of one source say nothing of another's, nor of loads without a source."""
    table = VectorTable.create(spark, str(tmp_path / "t"), 2)
    for n in range(3):
        table.load(points(spark, (f"plain{n}", "go", "p", "x")))
    for source in ("one", "two"):
        assert not table.load(points(spark, (source, "go", "p", "x")), source, 0).skipped
    assert set(contents(table)) == {"plain0", "plain1", "plain2", "one", "two"}
    with pytest.raises(ValueError):
        table.load(points(spark, ("x", "go", "p", "x")), "one")


def test_state_is_bounded_and_old_folders_can_go(spark, tmp_path):
    table = VectorTable.create(spark, str(tmp_path / "t"), 2)
    for n in range(6):
        table.load(points(spark, (f"p{n}", "go", "p", "x")), "s", n, compact_after=3)
    assert len(table._state()) <= 1 + 1 + 3 + 1
    before = contents(table)
    assert table.vacuum() > 0 and contents(table) == before and len(before) == 6
    assert len(list((tmp_path / "t" / "state").iterdir())) == 1


@pytest.mark.parametrize("bad", [[1.0, float("nan")], [float("inf"), 1.0], [1.0, None], None, [1.0]])
def test_vectors_without_a_direction_are_refused(spark, tmp_path, bad):
    table = VectorTable.create(spark, str(tmp_path / "t"), 2)
    with pytest.raises(PySparkException):
        table.load(spark.createDataFrame([("a", "go", "r", "p", "f", "c", bad)], POINT))
    assert contents(table) == {}


def test_order_decides_within_a_load(spark, tmp_path):
    table = VectorTable.create(spark, str(tmp_path / "t"), 2)
    rows = points(spark, ("a", "go", "p1", "longer"), ("a", "go", "p2", "x"))
    table.load(rows, order=F.length("code"))
    assert contents(table) == {"a": "longer"}


def test_many_loads_are_compacted(spark, tmp_path):
    table = VectorTable.create(spark, str(tmp_path / "t"), 2)
    for n in range(4):
        table.load(points(spark, ("a", "go", "p", str(n)), (f"id{n}", "go", "p", "x")), compact_after=3)
    base, loads = table._live(table._state())
    assert len(base) == 1 and len(loads) == 1
    assert contents(table) == {"a": "3", **{f"id{n}": "x" for n in range(4)}}


def test_small_loads_are_merged_without_rewriting_the_base(spark, tmp_path):
    table = VectorTable.create(spark, str(tmp_path / "t"), 2)
    table.load(points(spark, *[(f"b{i}", "go", "p", "x") for i in range(100)]))
    table.compact()
    for n in range(5):
        table.load(points(spark, ("b0", "go", "p", str(n)), (f"new{n}", "c", "p", "y")), compact_after=2)
    base, loads = table._live(table._state())
    assert base[0]["rows"] == 100 and len(loads) <= 2
    got = contents(table)
    assert len(got) == 105 and got["b0"] == "4" and got["new0"] == "y"


def test_create_is_idempotent_and_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        VectorTable(spark, path)
    VectorTable.create(spark, path, 2, "l2")
    assert VectorTable.create(spark, path, 2, "l2").metric == "l2"
    for other in ((3, "l2"), (2, "cosine")):
        with pytest.raises(ValueError):
            VectorTable.create(spark, path, *other)


def test_wrong_vector_length_fails_and_leaves_no_trace(spark, tmp_path):
    table = VectorTable.create(spark, str(tmp_path / "t"), 3)
    with pytest.raises(PySparkException):
        table.load(points(spark, ("a", "go", "p", "x")))
    assert contents(table) == {}


def test_language_filter_prunes_folders(spark, tmp_path):
    table = VectorTable.create(spark, str(tmp_path / "t"), 2)
    table.load(points(spark, ("a", "go", "p", "x"), ("b", "objective-c", "p", "y")))
    table.compact()
    only = table.read().filter("language = 'objective-c'")
    assert [r["chunk_id"] for r in only.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(language" in only._jdf.queryExecution().executedPlan().toString()


def test_a_language_with_most_rows_is_spread_over_files(spark, tmp_path):
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        table = VectorTable.create(spark, str(tmp_path / "t"), 2)
        hot = spark.range(6000).select(
            F.concat(F.lit("id"), "id").alias("chunk_id"), F.when(F.col("id") < 50, "c").otherwise("go").alias("language"),
            F.lit("r").alias("repo"), F.col("id").cast("string").alias("path"), F.lit("f").alias("function_name"),
            F.sha2(F.col("id").cast("string"), 512).alias("code"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("vector"))
        table.load(hot)
        files = table.read().select("language", F.input_file_name().alias("f")).distinct().groupBy("language").count().collect()
        assert {r["language"]: r["count"] for r in files}["go"] > 3
        assert table.check_count(6000)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_search_on_the_table(spark, tmp_path):
    table = VectorTable.create(spark, str(tmp_path / "t"), 2, encoder="e1")
    table.load(points(spark, ("a", "go", "p", "x"), ("b", "c", "p", "yyyy")))
    queries = spark.createDataFrame([(1, None, [1.0, 1.0])], "query_id long, language string, vector array<float>")
    assert [r["chunk_id"] for r in table.search(queries, "e1", threshold=0.9).orderBy("rank").collect()] == ["a"]
    with pytest.raises(ValueError):
        table.search(queries, "e2")


def test_last_by_key_reduces_copies_before_the_shuffle(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id", F.lit("v").alias("v")).repartition(4)
    last = upsert.last_by_key(rows, "k", F.col("id"))
    assert last.filter("k = 'hot'").first()["id"] == 8997 and last.count() == 6001
    assert "partial_max" in last._jdf.queryExecution().executedPlan().toString()


def test_load_counts(spark):
    new = points(spark, ("a", "go", "p1", "1"), ("a", "go", "p2", "2"), ("b", "c", "p1", "b"))
    got = {r["metric"]: r["rows"] for r in upsert.load_counts(new, new.limit(2)).collect()}
    assert got == {"offered": 3, "loaded": 2, "points": 2}


def test_last_by_key_reads_its_rows_once(spark):
    rows = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "y"), (None, 1, "n1"), (None, 2, "n2"), ("b", 5, None), ("c", 1, "z")],
        "k string, o int, v string")
    last = upsert.last_by_key(rows, "k", F.col("o"))
    assert sorted(map(tuple, last.collect()), key=str) == sorted([("a", 3, "y"), (None, 2, "n2"), ("b", 5, None), ("c", 1, "z")], key=str)
    plan = last._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1 and "Join" not in plan
