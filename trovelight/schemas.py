"""Row types of the tables that cross a source or sink boundary."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

REPO_HIT = _struct(full_name=_S, owner=_S, name=_S, language=_S, license=_S, stars=_L)

TREE_ENTRY = _struct(owner=_S, repo_name=_S, ordinal=_L, path=_S)

LISTED_FILE = _struct(root=_S, path=_S, absolute_path=_S, size_bytes=_L)

FILE_METADATA = _struct(
    path=_S, absolute_path=_S, language=_S, extension=_S, size_bytes=_L,
    line_count=_L, is_test_file=_B, is_entry_point=_B, is_supported=_B,
)

CHUNK = _struct(
    chunk_id=_S, language=_S, repo=_S, path=_S, function_name=_S, code=_S,
)
CHUNK_COLUMNS = CHUNK.fieldNames()

VECTOR_POINT = T.StructType(
    CHUNK.fields + [T.StructField("vector", T.ArrayType(T.FloatType()))]
)

INTERACTION = _struct(
    timestamp=T.TimestampType(), query=_S, language=_S, response=_S,
    chunk_ids=T.ArrayType(_S),
)
