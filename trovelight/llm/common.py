"""What the operators share: stored intermediates, Arrow batches, and small column helpers.

Conventions of the package, unless an operator's docstring says otherwise:

* an operator reads only the columns it names, so further columns of any name are ignored;
* null text counts as empty text; rows with a null key stay in the output with that null;
* repeated rows stay repeated; an empty table gives an empty table of the same schema.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trovelight.session import new_folder

#: ASCII white space as the contracts spell it: blank, tab, line feeds and form feeds.
WORD = "[^\\x20\\x09-\\x0D]+"


PART = 512  # rows of a batch that are worked on, and held as Python objects, at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written to the shared folder and read back.

    Cuts the lineage, survives lost executors, and gives later joins a plain scan on
    either side, so that adaptive execution can split the hot partitions of both.
    """
    path = new_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def arrow_schema(rows: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)


#: By module: what its tasks leave to the next ones of the same worker process, and for which key.
_kept: dict[str, tuple] = {}


def kept(owner: str, key, make: Callable):
    """``make()``, once per worker process for as long as tasks of the module ``owner`` ask for ``key``.

    Worker processes serve one operator after the other: a task of another module lets it go.
    """
    if owner not in _kept or _kept[owner][0] != key:
        _kept.pop(owner, None)  # the old one goes before the new one is made
        _kept[owner] = key, make()
    return _kept[owner][1]


def let_go(owner: str) -> None:
    """Drops what other modules than ``owner`` have kept, and returns free memory to the system.

    An idle worker process still counts as its executor's memory, and so do free pages it holds.
    """
    for other in set(_kept).difference([owner]):
        del _kept[other]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim:
        trim(0)


def map_arrow(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` on the Arrow batches of each task; it yields lists of row tuples."""
    arrow = arrow_schema(rows, schema)

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(run.__module__)
        for out in run(batches):
            columns = list(zip(*out)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            del out, columns
        let_go(run.__module__)

    return rows.mapInArrow(typed, schema)


def map_batches(rows: DataFrame, start: Callable[[], Callable], schema: str, part: int = PART) -> DataFrame:
    """``start()`` once per task, then its result on each Arrow batch, ``part`` rows at a time.

    The inner function takes a ``RecordBatch`` and returns a list of columns for ``schema``.
    """
    arrow = arrow_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(start.__module__)
        work = start()
        for batch in (b.slice(i, part) for b in batches for i in range(0, max(b.num_rows, 1), part)):
            columns = work(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                 for c, f in zip(columns, arrow)], schema=arrow)
            del batch, columns  # not held while the next ones are read
        del work
        let_go(start.__module__)

    return rows.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def runs(some: list[str], most: int) -> Iterator[list[str]]:
    """``some`` in order, in lists of at most ``most`` characters, or of a single longer text."""
    first = size = 0
    for i, one in enumerate(some):
        if size + len(one) > most and i > first:
            yield some[first:i]
            first, size = i, 0
        size += len(one)
    if some:
        yield some[first:]


def repeated(keys: pa.Array, rows: list[int]) -> pa.Array:
    """The keys at ``rows``, which may be none."""
    return keys.take(pa.array(rows, pa.int64()))


def remainder(key: str | Column, modulus: int) -> Column:
    """CRC-32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % modulus


def kind(rows: DataFrame, column: str) -> str:
    """The column's type as DDL."""
    return rows.schema[column].dataType.simpleString()
