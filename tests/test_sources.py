import os

import pytest

from trovelight.operators import chunking
from trovelight.plans.inventory_repos import inventory_roots
from trovelight.schemas import CHUNK_COLUMNS
from trovelight.sources import chunks as chunk_io
from trovelight.sources import files as file_io


def lay_out(root, names):
    for name, content in names.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)


TREE = {".env": b"x", ".git/h": b"x", "_priv/k.py": b"a\nb\n", "a/__main__.py": b"1", "a/b/c/empty.py": b"",
        "with space.py": b"x", "node_modules/z.js": b"z", "a/b/bad.py": b"ab\xffcd\xc3\xa9\n"}


@pytest.mark.parametrize("enough", [1, 2, 500])
def test_listing_sees_every_file(spark, tmp_path, enough):
    lay_out(tmp_path, TREE)
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    roots = spark.createDataFrame([(str(tmp_path) + "/",)], "root string")
    rows = {r["path"]: r for r in file_io.list_files(roots, enough=enough).collect()}
    assert {p: r["size_bytes"] for p, r in rows.items()} == {p: len(c) for p, c in TREE.items()}
    assert all(r["absolute_path"] == f"{tmp_path}/{p}" for p, r in rows.items())


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_inventory_reads_only_what_it_indexes(spark, tmp_path, scheme):
    lay_out(tmp_path, TREE)
    rows = {r["path"]: r for r in inventory_roots(spark.createDataFrame([(f"{scheme}{tmp_path}",)], "root string")).collect()}
    assert len(rows) == len(TREE)
    assert {p for p, r in rows.items() if r["is_indexed"]} == {"_priv/k.py", "a/__main__.py", "with space.py", "a/b/bad.py"}
    assert rows["_priv/k.py"]["line_count"] == 2 and rows["a/__main__.py"]["is_entry_point"]
    assert rows[".env"]["line_count"] is None


def test_raw_scan(spark, tmp_path):
    lay_out(tmp_path, {"Python/o__r__a.py": b"ab\xffcd\xc3\xa9", "go/_x__r__b.go": b"", "c/o__r__c.c": b"a\r\nb\rc\n", "go/deep/c.go": b"no", "stray.py": b"no"})
    got = {(r["lang_dir"], r["file_name"], r["code"]) for r in file_io.scan_raw_files(spark, str(tmp_path)).collect()}
    assert got == {("python", "o__r__a.py", "abcdé"), ("go", "_x__r__b.go", ""), ("c", "o__r__c.c", "a\nb\nc\n")}


def test_unreadable_files_are_null_or_skipped(spark, tmp_path):
    listed = spark.createDataFrame([("a", f"{tmp_path}/missing")], "path string, absolute_path string")
    assert file_io.read_contents(listed).collect()[0]["content"] is None


def test_written_files_can_be_written_again(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.txt", "1"), ("b.txt", "é")], "path string, content string")
    for _ in range(2):
        assert file_io.write_files(rows, str(tmp_path)) == 2
    assert (tmp_path / "b.txt").read_bytes() == "é".encode() and sorted(os.listdir(tmp_path)) == ["b.txt", "x"]


def test_file_addresses_name_local_paths():
    assert [file_io._local(x) for x in ("file:/a/b", "file:///a/b", "/a/b", "hdfs://n/a", "file://host/a")] == [
        "/a/b", "/a/b", "/a/b", "hdfs://n/a", "file://host/a"]


def chunk_rows(spark):
    raw = spark.createDataFrame([("ö__r__a.go", "func f() { }"), ("ö__r__b.sql", "sélect")], "file_name string, code string")
    return chunking.chunk_files(raw)


def test_chunk_lines_round_trip(spark, tmp_path):
    path = str(tmp_path / "chunks")
    for _ in range(2):  # replaces
        chunk_io.write_chunks(chunk_rows(spark), path)
    text = "".join(p.read_text(encoding="utf8") for p in (tmp_path / "chunks").glob("part-*"))
    assert "sélect" in text and "\\u" not in text
    back = chunk_io.read_chunks(spark, path)
    assert back.columns == CHUNK_COLUMNS
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, chunk_rows(spark).select(*CHUNK_COLUMNS).collect()))


def test_missing_and_empty_chunk_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        chunk_io.load_chunk_dataset(spark, str(tmp_path / "none"))
    chunk_io.write_chunks(chunk_rows(spark).limit(0), str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        chunk_io.read_chunks(spark, str(tmp_path / "empty"))


def test_dataset_export(spark, tmp_path):
    path = str(tmp_path / "dataset")
    assert chunk_io.export_dataset(chunk_rows(spark), path) == 2
    assert spark.read.parquet(path).columns == CHUNK_COLUMNS
