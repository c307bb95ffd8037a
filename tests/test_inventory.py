from pyspark.sql import functions as F

from trovelight.operators import inventory
from trovelight.plans.inventory_repos import clone_sessions, inventory_roots, repo_records
from trovelight.sources.files import list_files, write_files

FILES = "owner string, repo_name string, path string, code string"


def sample(spark):
    rows = [("o", "r", "src/main.py", "a\nb"), ("o", "r", "lib/x.GO", "x\n"), ("o", "r", "node_modules/z.js", "z"),
            ("o", "r", "empty.py", ""), ("o", "r", "notes.xyz", "n\r\nm\r"), ("o", "r", "big.py", "é" * 50_001),
            ("o", "r", "edge.py", "x" * 100_000), ("o", "q", "logo.png", "p")]
    return spark.createDataFrame(rows, FILES)


def test_flags_and_counts(spark):
    rows = {r["path"]: r for r in inventory.file_inventory(sample(spark)).collect()}
    assert {p for p, r in rows.items() if r["is_indexed"]} == {"src/main.py", "lib/x.GO", "notes.xyz", "edge.py"}
    main, other = rows["src/main.py"], rows["notes.xyz"]
    assert (main["language"], main["extension"], main["line_count"], main["is_entry_point"]) == ("python", ".py", 2, True)
    assert (other["language"], other["is_supported"], other["line_count"]) == (None, False, 2)
    assert rows["lib/x.GO"]["language"] == "go" and rows["big.py"]["size_bytes"] == 100_002
    assert rows["big.py"]["line_count"] is None


def test_totals_include_what_is_not_indexed(spark):
    got = {(r["owner"], r["repo_name"]): r for r in inventory.repo_summary(
        inventory.file_inventory(sample(spark))).collect()}
    assert (got["o", "r"]["total_files"], got["o", "r"]["indexed_files"]) == (7, 4)
    assert got["o", "r"]["languages"] == {"python": 2, "go": 1}
    assert (got["o", "q"]["total_files"], got["o", "q"]["indexed_files"], got["o", "q"]["languages"]) == (1, 0, {})
    totals = {r["repo_name"]: (r["total_files"], r["indexed_files"]) for r in inventory.repo_totals(
        inventory.file_inventory(sample(spark))).collect()}
    assert totals == {"r": (7, 4), "q": (1, 0)}


def test_large_repositories_are_paged_and_stay_whole(spark):
    rows = [("hot", "r", f"f{i}.py", "x") for i in range(1000)] + [("small", "r", "a.py", "x"), ("none", "r", "a.png", "x")]
    files = inventory.file_inventory(spark.createDataFrame(rows, FILES))
    docs = inventory.repo_documents(files, page_files=100).collect()
    hot = [d for d in docs if d["owner"] == "hot"]
    assert len(hot) == 10 and all(d["pages"] == 10 and d["indexed_files"] == 1000 for d in hot)
    assert max(len(d["files"]) for d in hot) < 200
    assert sorted(f["path"] for d in hot for f in d["files"]) == sorted(f"f{i}.py" for i in range(1000))
    assert [len(d["files"]) for d in docs if d["owner"] == "small"] == [1]
    assert [(d["page"], d["files"]) for d in docs if d["owner"] == "none"] == [(0, [])]


def test_sessions_and_records(spark, tmp_path):
    urls = spark.createDataFrame([("https://github.com/o/r.git",), ("https://github.com/o/s",)], "url string").withColumn(
        "cloned_at", F.timestamp_seconds(F.lit(1)))
    sessions = clone_sessions(urls, str(tmp_path))
    again = {r["url"]: r["session_id"] for r in clone_sessions(urls, str(tmp_path)).collect()}
    first = sessions.collect()
    assert all(again[r["url"]] == r["session_id"] and len(r["session_id"]) == 36 for r in first)
    paths = {r["name"]: r["local_path"] for r in first}
    assert paths["r"] == f"{tmp_path}/{first[0]['session_id'][:8]}/r" or paths["r"].endswith("/r")
    write_files(spark.createDataFrame([("a/b.py", "x\ny\n"), ("c.md", "z")], "path string, content string"), paths["r"])
    write_files(spark.createDataFrame([("only.png", "p")], "path string, content string"), paths["s"])
    found = inventory_roots(sessions.select(F.col("local_path").alias("root")))
    records = repo_records(sessions, found).orderBy("path").collect()
    mine = [r for r in records if r["name"] == "r"]
    assert {(r["total_files"], r["indexed_files"], tuple(r["languages"].items())) for r in mine} == {(2, 2, (("python", 1),))}
    assert [(r["path"], r["line_count"]) for r in mine] == [("a/b.py", 2), ("c.md", 1)]
    assert [(r["total_files"], r["path"]) for r in records if r["name"] == "s"] == [(1, None)]


def test_flat_records_do_not_depend_on_pages(spark):
    rows = [("hot", "r", f"f{i}.py", "x") for i in range(60)] + [("none", "r", "a.png", "x")]
    files = inventory.file_inventory(spark.createDataFrame(rows, FILES))
    flat = sorted((r["owner"], r["path"] or "", r["total_files"]) for r in inventory.repo_files(files).collect())
    assert len(flat) == 61 and flat[-1] == ("none", "", 1)
    for size in (7, 1000):
        nested = inventory.repo_documents(files, page_files=size).collect()
        assert sorted(f["path"] for d in nested for f in d["files"]) == sorted(p for _, p, _ in flat if p)


def test_walks_are_dealt_out(spark, tmp_path):
    """More tasks than cores take part although all files lie below one folder."""
    files = spark.range(400).select(F.concat(F.lit("deep/er/"), F.col("id") % 40, F.lit("/f"), "id").alias("path"), F.lit("x").alias("content"))
    write_files(files, str(tmp_path / "tree"))
    listed = list_files(spark.createDataFrame([(str(tmp_path / "tree"),)], "root string"))
    assert listed.count() == 400 and listed.select("path").distinct().count() == 400
    tasks = listed.where("path like 'deep/er/%'").select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks >= 4
    two = list_files(spark.createDataFrame([(str(tmp_path / "tree"),)], "root string"), depth=4)
    assert two.count() == 400
    assert list_files(spark.createDataFrame([(str(tmp_path / "tree"),)], "root string"), depth=3).count() == 0
