"""SQL functions of the session: equal to the Column builders, no Python in the plan."""

import pytest
from pyspark.sql import functions as F

from checks.compare import difference
from checks.fixtures import view
from trovelight.functions.chunk_id import chunk_id
from trovelight.functions.languages import infer_language
from trovelight.functions.sql_functions import register_sql_functions
from trovelight.functions.urls import parse_repo_url

SF = "/root/testdata/sf0.001"
URLS = ["https://github.com/o/r", "https://github.com/o/r.git/", "github.com/o/r/tree/main", "https://gitlab.com/o/r", None, "",
        "http://github.com/o/r//", "https://github.com/o", "git://github.com/a/b.git", "///", "https://github.com/ö/ü"]


def test_parse_repo_url_equals_columns(spark):
    register_sql_functions(spark)
    rows = spark.createDataFrame([(u,) for u in URLS], "url string")
    rows.createOrReplaceTempView("some_urls")
    got = spark.sql("SELECT url, tl_parse_repo_url(url) AS p FROM some_urls").collect()
    want = rows.select("url", parse_repo_url(F.col("url")).alias("p")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_chunk_id_and_language_equal_columns(spark):
    register_sql_functions(spark)
    points = view(spark, SF, "vec_fx")
    points.createOrReplaceTempView("points_for_ids")
    got = spark.sql("SELECT tl_chunk_id(language, repo, path, function_name, code) AS id, tl_infer_language(code) AS l "
                    "FROM points_for_ids").collect()
    want = points.select(chunk_id(*[F.col(c) for c in ("language", "repo", "path", "function_name", "code")]).alias("id"),
                         infer_language(F.col("code")).alias("l")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


@pytest.mark.parametrize("key", ["sql_parse_repo_url", "sql_infer_language", "sql_chunk_id"])
def test_no_python_in_plan_and_oracle_agrees(spark, key):
    import __spark_entry__ as contract

    plan = contract.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    nodes = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInArrow", "MapInPandas", "InPandas", "PythonMapIn")
    assert not [n for n in nodes if n in plan]
    assert difference(spark, SF, key) is None
