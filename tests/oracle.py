"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(None if r[i] is None or r[i] != r[i] else r[i] for i in order) for r in rows), key=repr)


def same(df, con, sql):
    cur = con.execute(sql)
    want = canonical(cur.fetchall(), [c[0] for c in cur.description])
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1], next((a, b) for a, b in zip(got[1], want[1], strict=True) if a != b)
