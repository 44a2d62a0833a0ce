"""Queries over small tables that hold what a narrower reading would leave out."""

from __future__ import annotations

import datetime as dt
import random

import __spark_entry__ as entry
from quillbar.operators import align


def _run(spark, tmp_path, query, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return sorted(tuple(r) for r in entry.queries()[query](spark, str(tmp_path)).collect())


def _futures(spark):
    old, new = dt.date(2026, 10, 19), dt.date(2026, 10, 26)
    rows = [
        ("NFO", "A", "A1", "24-NOV-2026", new), ("NFO", "A", "A2", "29-DEC-26", new), ("NFO", "A", "A3", "27-jan-2027", new), ("NFO", "A", "A4", "24-FEB-27", new),
        ("MCX", "A", "M1", "30-OCT-26", new), ("CDS", "C", "C0", "20-OCT-26", old), ("CDS", "C", "C1", "28-NOV-26", new), ("CDS", None, "N1", "28-NOV-26", new), ("CDS", "C", "C2", None, new),
    ]
    return spark.createDataFrame([(e, n, s, s, x, "FUT", d) for e, n, s, x, d in rows], "exchange string, name string, symbol string, token string, expiry string, instrumenttype string, snapshot_date date")


def test_nearest_futures_of_every_exchange_and_form(spark, tmp_path):
    f = _futures(spark)
    assert _run(spark, tmp_path, "w16_nearest_expiries", symtoken=f) == [("A", "A1", 1), ("A", "A2", 2), ("A", "A3", 3), ("A", "M1", 1), ("C", "C1", 1)]
    assert _run(spark, tmp_path, "o19_calendar_spreads", symtoken=f) == [("A", "A1", "A2", 2), ("A", "A1", "A3", 3)]


BARS = "symbol string, exchange string, interval string, timestamp bigint, open double, high double, low double, close double, volume bigint, oi bigint, created_at timestamp"


def test_clusters_over_every_exchange(spark, tmp_path):
    rows = []
    for k in range(30):
        up = 100.0 + 7 * (k % 5) + k
        for s, e, c in (("A", "NSE", up), ("A", "BSE", 2 * up), ("B", "NSE", 3 * up), ("Z", "NSE", 0.0 if k == 9 else 100.0 + 9 * (k % 3 == 1))):
            rows.append((s, e, "D", (20000 + k) * 86400, c, c, c, c, 1, 0, None))
    got = _run(spark, tmp_path, "pf5_clusters", market_data=spark.createDataFrame(rows, BARS))
    assert got == [("A/BSE", "A/BSE"), ("A/NSE", "A/BSE"), ("B/NSE", "A/BSE"), ("Z/NSE", "Z/NSE")]


def test_correlated_pairs_in_blocks(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = [rng.gauss(0, 1) for _ in range(3)]
        rows += [(f"s{i:02}", dt.date(2026, 1, 1) + dt.timedelta(days=k), 0.01 * (1 if i == 19 else base[i % 3] + rng.gauss(0, 0.7))) for i in range(20) if rng.random() < 0.2 + 0.05 * i]
    long = spark.createDataFrame(rows, "symbol string, day date, ret double")
    want = {(r.a, r.b): (r.n, r.corr) for r in align.pair_correlations(long.where("symbol <> 's19'")).where("corr >= 0.6").collect()}
    assert len(want) > 5
    for members in (3, 256):
        got = {(r.a, r.b): (r.n, r.corr) for r in align.correlated_pairs(long, 0.6, members=members).collect()}
        assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-9 for p in want)


def test_first_open_interest_in_time(spark, tmp_path):
    rows = [(s, e, i, t, 1.0, 1.0, 1.0, 1.0, 1, o, None) for s, e, i, t, o in (("A", "MCX", "D", 60, None), ("A", "MCX", "1m", 120, 7), ("B", "MCX", "1m", 120, 5), ("A", "MCX", "1m", 180, 3), ("A", "NSE", "D", 60, 0), ("A", "NSE", "D", 90, 9), ("A", "BSE", "D", 60, None))]
    assert _run(spark, tmp_path, "a12_first_non_null", market_data=spark.createDataFrame(rows, BARS)) == [("BSE", None), ("MCX", 7), ("NSE", 0)]
