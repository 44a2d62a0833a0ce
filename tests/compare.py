"""Side-by-side comparison of a query and its DuckDB twin."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings market_data trading_calendar symtoken cds_symbols "
    "download_jobs job_items sandbox_orders pending_orders sandbox_gtt mix_targets"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def norm(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, decimal.Decimal):
        return norm(float(v))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return norm(float(v)) if abs(v) < 2**53 else str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v) if v is not None else None


def rows_of(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list, list]:
    """(rows, in Spark only, in DuckDB only)."""
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return len(a), [("columns", df.columns)], [("columns", names)]
    b = rows_of(names, cur.fetchall())
    if a == b:
        return len(a), [], []
    from collections import Counter

    ca, cb = Counter(a), Counter(b)
    return len(a), list((ca - cb).elements()), list((cb - ca).elements())
