from pyspark.sql import functions as F

from trovelight.fixed_values import EXTENSION_LANGUAGE
from trovelight.operators import selection

REPOS = "full_name string, language string, license string, stars long"
TREE = "owner string, repo_name string, ordinal long, path string, size_bytes long"


def test_repositories_qualify_and_rank(spark):
    rows = [("a/x", "go", "mit", 900), ("a/x", "go", "mit", 950), ("b/x", "go", "mit", 950), ("c/x", "go", "mit", 500),
            ("d/x", "go", "mit", 499), ("e/x", "go", "apache-2.0", 9999), ("a/x", "c", "mit", 700)]
    got = selection.select_repos(spark.createDataFrame(rows, REPOS), max_repos=2).collect()
    assert sorted((r["language"], r["rank"], r["full_name"], r["stars"]) for r in got) == [
        ("c", 1, "a/x", 700), ("go", 1, "a/x", 950), ("go", 2, "b/x", 950)]
    only = selection.qualify_repos(spark.createDataFrame(rows, REPOS), language="c")
    assert [r["full_name"] for r in only.collect()] == ["a/x"]


def test_oversized_files_use_up_a_place(spark):
    rows = [("o", "r", 1, "big.go", 20_000), ("o", "r", 2, "a.go", 19_999), ("o", "r", 3, "b.go", 1),
            ("o", "r", 4, "c.GO", 1), ("o", "r", 0, "d/.py", 5), ("o", "q", 9, "src/e.go", 1)]
    got = selection.select_files(spark.createDataFrame(rows, TREE), max_files=2).collect()
    assert sorted(r["file_name"] for r in got) == ["o__q__src__e.go", "o__r__a.go", "o__r__d__.py"]


def test_files_of_selected_repositories(spark):
    tree = spark.createDataFrame([("o", "r", i, f"f{i}.{e}", 1) for i, e in enumerate(["go", "py", "go", "c"])]
                                 + [("z", "r", 1, "f.go", 1)], TREE)
    chosen = spark.createDataFrame([("go", "o", "r", 1), ("c", "o", "r", 1), ("cobol", "z", "r", 1)],
                                   "language string, owner string, repo_name string, rank int")
    for bound in (None, 30):
        got = selection.select_files(tree, chosen, max_repos=bound).collect()
        assert sorted((r["language"], r["path"]) for r in got) == [("c", "f3.c"), ("go", "f0.go"), ("go", "f2.go")]


def test_ranking_limits_rows_before_the_shuffle(spark):
    """One repository holds nearly all rows; each map task passes on only the rows that can win."""
    rows = [("hot", "r", i, f"f{i}.go", 1) for i in range(3000)] + [("o", f"r{i}", i, "a.go", 1) for i in range(20)]
    tree = spark.createDataFrame(rows, TREE).repartition(4)
    got = selection.select_files(tree, max_files=20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")
    hot = got.filter("owner = 'hot'").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in hot] == list(range(20)) and got.count() == 40


def test_summary_and_pending_languages(spark):
    files = [("go", f"o__r{i}__a.go") for i in range(3)] + [("go", "o2__r0__b.go"), ("c", "o__r0__a.c"), ("c", "stray.c")]
    frame = spark.createDataFrame(files, "language string, file_name string")
    summary = {r["language"]: (r["repos"], r["files"]) for r in selection.scrape_summary(frame).collect()}
    assert summary == {"go": (3, 4), "c": (1, 2)}  # same-named repositories of two owners count once
    pending = {r["language"] for r in selection.pending_languages(spark, frame, 3).collect()}
    assert pending == set(EXTENSION_LANGUAGE.values()) - {"go"}
    assert selection.pending_languages(spark, frame.filter(F.lit(False))).count() == 25
