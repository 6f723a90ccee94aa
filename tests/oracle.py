"""Compares a query with its DuckDB SQL over the same tables, whatever the order of rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, bool) or value is None:
        return value
    return value


def compare(spark, sf_dir: str, function, sql: str) -> str:
    """Empty if the rows are equal, else what differs."""
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = function(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in names]
    want = sorted((tuple(normal(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if got == want:
        return ""
    gone, more = [x for x in want if x not in set(got)], [x for x in got if x not in set(want)]
    return f"{len(got)} and {len(want)} rows of {names}; only here {more[:2]}; only there {gone[:2]}"
