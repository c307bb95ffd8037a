"""Files on storage all executors can reach: listing, reading, writing.

Spark's own ``binaryFile`` source skips names starting with a dot or underscore and
empty files, all of which an inventory must see, so the listing is a job of its own.
"""

from __future__ import annotations

import os
import re
from functools import reduce
from typing import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import file_name
from ..functions.text import decode_utf8, unix_newlines
from ..schemas import LISTED_FILE
from ..session import stored

_ROWS = 10_000
_BYTES = 32 << 20


_SCHEMES = ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss")  # what Arrow can open
_ALIASES = {"s3a": "s3", "s3n": "s3"}
_ADDRESS = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/]*)")
_stores: dict[str, fs.FileSystem] = {}  # one client per authority and worker


def _open(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, opened once per authority, and the path within it."""
    scheme, authority = _ADDRESS.match(address).groups()
    known = _ALIASES.get(scheme.lower(), scheme.lower())
    if known not in _SCHEMES:
        raise ValueError(f"cannot open {scheme}:// addresses; use one of {', '.join(_SCHEMES)}")
    renamed = known + address[len(scheme):]
    if (root := f"{known}://{authority}") not in _stores:
        _stores[root], path = fs.FileSystem.from_uri(renamed)
        return _stores[root], path
    inner = renamed[len(root):]
    return _stores[root], authority + inner if known in ("s3", "gs", "gcs") else inner


def _entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    """``(name, is_folder, size)`` directly below; links to folders are not followed."""
    if "://" not in folder:
        try:
            found = os.scandir(folder)
        except PermissionError:
            return
        for entry in found:
            if entry.is_dir(follow_symlinks=False):
                yield entry.name, True, 0
            elif entry.is_file():
                yield entry.name, False, _size(entry)
        return
    store, path = _open(folder)
    for info in store.get_file_info(fs.FileSelector(path)):
        yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def _size(entry: os.DirEntry) -> int:
    try:
        return entry.stat().st_size
    except (FileNotFoundError, PermissionError):
        return 0  # still counted, never indexed


def _read(path: str) -> bytes:
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    store, inner = _open(path)
    with store.open_input_stream(inner) as f:
        return f.read()


def _write(path: str, content: bytes, attempt: str) -> None:
    """Whole-file replace: a retried or duplicate task leaves the same file behind."""
    if "://" not in path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        partial = f"{os.path.dirname(path)}/.{attempt}.part"
        with open(partial, "wb") as f:
            f.write(content)
        os.replace(partial, path)
        return
    store, inner = _open(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner) as f:
        f.write(content)


_LOCAL_SCHEME = r"^file:(//)?(?=/[^/]|/$)"


def _local(uri: str) -> str:
    """A ``file:`` URI as a plain path; other addresses unchanged."""
    return re.sub(_LOCAL_SCHEME, "", uri)


def _rows(records: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(records, columns=["root", "path", "absolute_path", "size_bytes", "is_folder"])


def _walk(depth: int | None):
    """Expand folder rows by ``depth`` levels (all the way if None); file rows pass through."""

    def job(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for frame in frames:
            for root, path, absolute, size, is_folder in frame.itertuples(index=False):
                if not is_folder:
                    held.append((root, path, absolute, size, False))
                todo = [(path, absolute, 0)] if is_folder else []
                while todo:
                    inner, where, level = todo.pop()
                    for name, below, bytes_ in _entries(where):
                        child = f"{inner}/{name}" if inner else name
                        if below and (depth is None or level + 1 < depth):
                            todo.append((child, f"{where}/{name}", level + 1))
                        else:
                            held.append((root, child, f"{where}/{name}", bytes_, below))
                        if len(held) >= _ROWS:
                            yield _rows(held)
                            held = []
        if held:
            yield _rows(held)

    return job


def list_files(roots: DataFrame, column: str = "root", depth: int | None = None,
               enough: int | None = None) -> DataFrame:
    """Every regular file below each root: ``root, path, absolute_path, size_bytes``.

    Level by level, the folders found are dealt out to all tasks anew, until there are
    ``enough`` of them (four per core) for each task to walk its own to the end; so neither
    one huge root nor one huge folder stays with one task. The levels are stored. ``depth``
    limits how many levels are looked at.
    """
    spark = roots.sparkSession
    tasks = spark.sparkContext.defaultParallelism * 2
    enough = 2 * tasks if enough is None else enough
    schema = "root string, path string, absolute_path string, size_bytes long, is_folder boolean"
    clean = F.regexp_replace(F.regexp_replace(F.col(column), _LOCAL_SCHEME, ""), "(?<=.)/+$", "")
    folders = roots.select(
        F.col(column).alias("root"), F.lit("").alias("path"), clean.alias("absolute_path"),
        F.lit(0).cast("long").alias("size_bytes"), F.lit(True).alias("is_folder"))
    found, level = [], 0
    while True:
        rest = None if depth is None else depth - level
        dealt = folders.repartition(tasks, "absolute_path")
        if level and (rest == 0 or not (n := folders.count()) or n >= enough):
            if rest != 0 and n:
                found.append(dealt.mapInPandas(_walk(rest), schema).where("not is_folder"))
            break
        listed = stored(dealt.mapInPandas(_walk(1), schema), "listing")
        found.append(listed.where("not is_folder"))
        folders, level = listed.where("is_folder"), level + 1
    return reduce(DataFrame.unionByName, found).select(*LISTED_FILE.fieldNames())


def _reader(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        held, size, begin = [], 0, 0
        for i, (path, wanted) in enumerate(zip(frame["absolute_path"], frame["_wanted"])):
            try:
                content = _read(path) if wanted else None
            except (FileNotFoundError, PermissionError):
                content = None  # any other error is not the file's own and fails the task
            held.append(content)
            size += len(content or b"")
            if size >= _BYTES:
                yield frame.iloc[begin:i + 1].drop(columns="_wanted").assign(content=held)
                held, size, begin = [], 0, i + 1
        if held:
            yield frame.iloc[begin:].drop(columns="_wanted").assign(content=held)


def read_contents(files: DataFrame, where: str | None = None) -> DataFrame:
    """Add ``content`` (bytes). Null where ``where`` is false, and for unreadable files.

    Rows are dealt out by path first, whichever task listed them: reading is the
    expensive part and must not follow the shape of the folders.
    """
    tasks = files.sparkSession.sparkContext.defaultParallelism * 4
    wanted = F.lit(True) if where is None else F.coalesce(F.expr(where), F.lit(False))
    dealt = files.withColumn("_wanted", wanted).repartition(tasks, "absolute_path")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return dealt.mapInPandas(_reader, f"{columns}, content binary")


def scan_raw_files(spark: SparkSession, root: str) -> DataFrame:
    """Text of the files at ``<root>/<language folder>/<name>``: ``lang_dir, file_name, code``.

    Undecodable bytes are dropped and line ends become line feeds; unreadable files are
    skipped.
    """
    listed = list_files(spark.createDataFrame([(root,)], "root string"), depth=2)
    direct = listed.filter(F.size(F.split("path", "/")) == 2)
    read = read_contents(direct).filter(F.col("content").isNotNull())
    return read.select(
        F.lower(F.split_part("path", F.lit("/"), F.lit(1))).alias("lang_dir"),
        file_name(F.col("path")).alias("file_name"),
        unix_newlines(decode_utf8(F.col("content"))).alias("code"),
    )


def write_files(files: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Write each row's bytes to ``<root>/<path>`` from the tasks; returns the file count."""
    base = _local(root).rstrip("/")

    def job(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                _write(f"{base}/{name}", bytes(data), str(attempt))
            yield pd.DataFrame({"files": [len(frame)]})

    rows = files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    return rows.mapInPandas(job, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
