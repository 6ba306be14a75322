"""Compare registered queries with their SQL in DuckDB, values rounded as little as their types ask."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def views(folder: str):
    """A connection with each table of a data directory as a view."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def plain(x):
    """A value that compares and sorts."""
    if x is None:
        return "~null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    if type(x).__name__.startswith("float"):
        return f"{float(x):.9g}"
    return str(x)


def differences(spark, con, query, sql: str, folder: str) -> str:
    """What is wrong, or nothing."""
    df = query(spark, folder)
    rel = con.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(rel.columns):
        return f"columns {columns} and {sorted(rel.columns)}"
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if mine == theirs:
        return ""
    a, b = set(mine) - set(theirs), set(theirs) - set(mine)
    return f"{len(mine)} and {len(theirs)} rows, {len(a)} and {len(b)} of them alone: {sorted(a)[:3]} {sorted(b)[:3]}"
