"""Runs a query on Spark and its SQL on DuckDB and compares columns, row counts and values."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def norm(v) -> str:
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    if isinstance(v, int):
        return str(v) if abs(v) < 10**6 else str(v)
    return str(v)


def compare(df, con, sql: str) -> tuple[bool, str]:
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    got_cols = df.columns
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns: got-only {sorted(set(got_cols) - set(want_cols))}, want-only {sorted(set(want_cols) - set(got_cols))}"
    order = sorted(got_cols)
    gi, wi = [got_cols.index(c) for c in order], [want_cols.index(c) for c in order]
    g = sorted(tuple(norm(r[i]) for i in gi) for r in df.collect())
    w = sorted(tuple(norm(r[i]) for i in wi) for r in want)
    if g == w:
        return True, f"{len(g)} rows"
    gs, ws = set(g), set(w)
    a, b = [x for x in g if x not in ws][:1], [x for x in w if x not in gs][:1]
    detail = ""
    if a and b:
        detail = "; ".join(f"{c}: {x!r} != {y!r}" for c, x, y in zip(order, a[0], b[0]) if x != y)
    return False, f"rows {len(g)} vs {len(w)}; {detail or (a, b)}"
