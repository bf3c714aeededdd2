"""Compares queries with their SQL in DuckDB, as rows in any order."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(df, con, sql: str, most: int = 3) -> list:
    names = sorted(df.columns)
    got = Counter(tuple(r[n] for n in names) for r in df.collect())
    result = con.execute(sql)
    found = [c[0] for c in result.description]
    if sorted(found) != names:
        return [("columns", names, sorted(found))]
    at = [found.index(n) for n in names]
    want = Counter(tuple(r[i] for i in at) for r in result.fetchall())
    return [("only in Spark", *(got - want).keys())][:most] * bool(got - want) + [("only in SQL", *(want - got).keys())][:most] * bool(want - got)
