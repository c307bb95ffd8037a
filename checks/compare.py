"""Run registered queries against their oracle SQL: ``python -m checks.compare [sf_dir] [key ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from trovelight.session import build_session

from .fixtures import TABLES
from .oracles import ORACLES
from .queries import QUERIES


def oracle_frame(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con.execute(sql).df()


def normalised(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name; nulls alike."""
    ordered = frame[sorted(frame.columns)].astype(object)
    rows = ordered.where(ordered.notna(), None).itertuples(index=False, name=None)

    def cell(v):
        if isinstance(v, float) and v.is_integer():
            return str(int(v))
        return "\\N" if v is None else str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


def difference(spark, sf_dir: str, key: str) -> str | None:
    """None when both engines agree, else what differs first."""
    ours = QUERIES[key](spark, sf_dir).toPandas()
    theirs = oracle_frame(sf_dir, ORACLES[key])
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    a, b = normalised(ours), normalised(theirs)
    if a != b:
        first = next((p for p in zip(a, b) if p[0] != p[1]), (a[-1:], b[-1:]))
        return f"{len(a)} rows != {len(b)} rows or values differ: {str(first)[:600]}"
    return None if a else "no rows"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", os.environ.get("COMPARE_MASTER", "local[8]"), 8)
    spark.sparkContext.setLogLevel("ERROR")
    for key in keys:
        began = time.time()
        try:
            if key in ORACLES:
                said = difference(spark, sf_dir, key) or "ok"
            else:
                said = f"rows only: {QUERIES[key](spark, sf_dir).count()}"
        except Exception as error:
            said = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{key:24s} {time.time() - began:6.1f}s {said}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
