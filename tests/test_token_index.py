"""Inverted token lists: equal to scanning every row with has_tokens, and reading only lists."""

import pytest
from pyspark.sql import functions as F

from checks.compare import difference
from checks.fixtures import view
from trovelight.functions.paths import has_tokens
from trovelight.operators import token_index

QUESTIONS = ["SRC7", "src", "src3", "src3__30", "30 src3", "", "  ", "src1 src1", "nope", "7", "Src0 0", "é"]


@pytest.fixture(scope="module")
def points(spark):
    rows = [("a", "src7__1", "src7"), ("b", "SRC7__2", "Src7"), ("c", None, "src3"), ("d", "src3__30", None),
            ("e", "x/é__7", "src1"), ("e", "x/é__7", "src1"), ("f", "", ""), ("g", "30-src3", "src0 0")]
    return spark.createDataFrame(rows, "chunk_id string, path string, repo string")


@pytest.mark.parametrize("field", ["path", "repo"])
def test_lookup_equals_scan(spark, points, field):
    index = token_index.open_index(spark, token_index.build_token_index(points, ("path", "repo")))
    for asked in QUESTIONS:
        got = sorted(r[0] for r in token_index.lookup(index, field, asked).collect())
        want = sorted({r[0] for r in points.where(F.col(field).isNotNull() & has_tokens(F.col(field), asked)).collect()})
        assert got == want, asked


def test_whole_table_equals_scan(spark):
    points = view(spark, "/root/testdata/sf0.01", "vec_fx")
    index = token_index.open_index(spark, token_index.build_token_index(points, ("repo", "path")))
    for field, asked in [("path", "src7"), ("repo", "src3"), ("path", "src2 12"), ("repo", "src")]:
        got = sorted(r[0] for r in token_index.lookup(index, field, asked).collect())
        want = sorted(r[0] for r in points.where(has_tokens(F.col(field), asked)).select("chunk_id").collect())
        assert got == want


def test_plan_reads_only_the_asked_lists(spark, points):
    index = token_index.open_index(spark, token_index.build_token_index(points, ("path", "repo")))
    plan = token_index.lookup(index, "path", "src7 1")._jdf.queryExecution().executedPlan().toString()
    buckets = sorted({token_index.bucket_of(t) for t in ("src7", "1")})
    assert "bucket#" in plan and f"IN ({','.join(map(str, buckets))})" in plan  # folders pruned
    assert "In(token, [1,src7])" in plan  # row groups skipped by statistics
    assert "struct<point_id:string,token:string>" in plan  # lists only: no point is read


def test_oracle_agrees(spark):
    assert difference(spark, "/root/testdata/sf0.001", "indexed_tokens") is None
