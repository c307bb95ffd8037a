"""End to end: selection to table, and shipping of worker code."""

import os
import subprocess
import sys
import textwrap

from pyspark.sql import functions as F

from trovelight.operators.embedding import HashingEncoder
from trovelight.plans.build_corpus import build_corpus, select_raw_files
from trovelight.settings import Settings
from trovelight.sources.vector_table import VectorTable

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def inputs(spark):
    repos = spark.createDataFrame(
        [("o/big", "go", "mit", 900), ("o/small", "go", "mit", 600), ("p/lib", "python", "mit", 700), ("x/no", "go", "gpl", 9999)],
        "full_name string, language string, license string, stars long")
    files = spark.createDataFrame(
        [("o", "big", 1, "a.go", "func a() { }"), ("o", "big", 2, "b.py", "def no(): pass"), ("o", "big", 3, "c.go", "// none"),
         ("o", "small", 1, "d/e.go", "func d() {\n}\nfunc e() { }"), ("p", "lib", 1, "f.py", "def f(): pass"), ("x", "no", 1, "g.go", "func g() { }")],
        "owner string, repo_name string, ordinal long, path string, code string")
    return repos, files.withColumn("size_bytes", F.octet_length("code").cast("long")), files


def test_repositories_to_table(spark, tmp_path):
    raw = select_raw_files(*inputs(spark))
    assert sorted(r["file_name"] for r in raw.collect()) == ["o__big__a.go", "o__big__c.go", "o__small__d__e.go", "p__lib__f.py"]
    encoder = HashingEncoder(32)
    table = VectorTable.create(spark, str(tmp_path / "t"), 32, encoder=encoder.name)
    assert build_corpus(raw, table, str(tmp_path / "chunks"), encoder).rows == 4
    got = {(r["repo"], r["path"], r["function_name"]) for r in table.read().collect()}
    assert got == {("o", "o__big__a.go", "func_0"), ("o", "o__small__d__e.go", "func_0"), ("o", "o__small__d__e.go", "func_1"),
                   ("p", "p__lib__f.py", "f")}
    build_corpus(raw, table, str(tmp_path / "chunks2"), encoder)
    assert table.check_count(4) == 4


def test_finished_languages_are_skipped(spark):
    have = spark.createDataFrame([("go", "a__r1__x.go"), ("go", "a__r2__x.go")], "language string, file_name string")
    raw = select_raw_files(*inputs(spark), Settings(MAX_REPOS=2), have)
    assert [r["file_name"] for r in raw.collect()] == ["p__lib__f.py"]


def test_contents_are_not_shuffled_for_the_choice(spark, tmp_path):
    repos, tree, contents = inputs(spark)
    contents.write.parquet(str(tmp_path / "contents"))
    plan = select_raw_files(repos, tree, spark.read.parquet(str(tmp_path / "contents")))._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("FileScan")]
    assert "BroadcastHashJoin" in above.split("BroadcastExchange")[0]


def test_worker_code_travels_with_the_job(tmp_path):
    """Workers start in another folder and cannot import this package."""
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from checks.queries import QUERIES
        from trovelight.session import build_session
        spark = build_session("ship", "local[2]", 2, spark__ui__enabled="false")
        found = spark.range(1).mapInArrow(lambda it: (b for b in it if __import__("importlib.util").util.find_spec("trovelight")), "id long").count()
        assert found == 0, "the workers can import the package, so this test proves nothing"
        for key in ("vector_topk", "vector_topk_blocks", "chunks_all", "source_scan", "prompt_answers"):
            assert QUERIES[key](spark, "/root/testdata/sf0.001").count() > 0, key
        print("shipped")
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "shipped" in done.stdout, done.stderr[-3000:]
