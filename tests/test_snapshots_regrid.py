from __future__ import annotations

import datetime as dt
import random

from quillbar.operators.regrid import counter_increments, missing_periods, session_grid, spread_over_cells
from quillbar.operators.snapshots import instrument_changes

D = dt.date


def _inst(spark, rows):
    return spark.createDataFrame(rows, "id bigint, exchange string, token string, lotsize int, expiry string, tick_size double, snapshot_date date, k string")


def test_changes(spark):
    a, b, c = D(2026, 1, 5), D(2026, 1, 12), D(2026, 1, 19)
    rows = [
        (1, "NSE", " 7", 1, "29-DEC-26", 0.05, a, "x"), (2, "NSE", "7 ", 1, "29-DEC-2026", 0.0500000001, b, "x"), (3, "NSE", "7", 2, "29-DEC-26", 0.05, c, "x"),
        (4, "NSE", "8", 1, None, None, a, "x"), (5, "NSE", "8", 1, " ", float("nan"), b, "x"), (6, "NSE", "9", 1, None, 0.1, b, "x"), (7, "NSE", "9", 5, None, 0.1, b, "x"), (8, "NSE", "9", 1, None, 0.1, c, "x"),
        (9, "NSE", None, 1, None, 0.1, c, "x"), (10, None, "5", 1, None, 0.1, c, "x"), (11, "NSE", "6", 1, None, 0.1, None, "x"),
    ]
    got = sorted(tuple(r) for r in instrument_changes(_inst(spark, rows), 3).collect())
    assert got == [
        ("2026-01-12", "NSE", "9", "added"), ("2026-01-19", "NSE", "7", "changed"), ("2026-01-19", "NSE", "8", "removed"), ("2026-01-19", "NSE", "9", "changed"),
    ]
    assert instrument_changes(_inst(spark, [])).count() == 0


def test_changes_against_sets(spark):
    random.seed(3)
    days = [D(2026, 1, 5) + dt.timedelta(days=7 * i) for i in range(5)]
    rows, state = [], []
    for d in days:
        s = {str(t): random.choice([1, 2]) for t in range(60) if random.random() < 0.5}
        state.append(s)
        rows += [(len(rows) + 1, "X", t, v, None, 0.05, d, "x") for t, v in s.items()]
    want = set()
    for d, p, q in zip(days[1:], state, state[1:]):
        want |= {(str(d), t, "added") for t in q.keys() - p.keys()} | {(str(d), t, "removed") for t in p.keys() - q.keys()} | {(str(d), t, "changed") for t in p.keys() & q.keys() if p[t] != q[t]}
    for n in (1, 7, 40):
        assert {(r.snapshot_date, r.token, r.change_kind) for r in instrument_changes(_inst(spark, rows), n).collect()} == want


BARS = "symbol string, exchange string, interval string, timestamp bigint, open double, high double, low double, close double, volume bigint, oi bigint, created_at timestamp, slot int"


def _bar(s, i, t, v=10, e="NSE"):
    return (s, e, i, t, 1.0, 1.0, 1.0, 1.0, v, None, None, 0)


def test_holes_and_distribution(spark):
    o = 1_760_000_400 - (1_760_000_400 + 19800) % 86400 + 33300
    day = (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=o + 19800)).date()
    cal = spark.createDataFrame([("NSE", day, o, o + 590, "regular"), ("NSE", day + dt.timedelta(days=1), o + 86400, o + 86400 + 600, "regular"), ("NSE", day + dt.timedelta(days=3), o + 3 * 86400, o + 3 * 86400 + 600, "x")], "exchange string, session_date date, open_ts bigint, close_ts bigint, slot string")
    bars = spark.createDataFrame(
        [_bar("A", "1m", o), _bar("A", "1m", o + 90, 30), _bar("A", "1m", o + 90, 30), _bar("A", "1m", o + 300, None), _bar("A", "1m", o - 60), _bar("A", "1m", o + 590), _bar("A", "1m", o + 86400 + 120), _bar("A", "1m", None), _bar("A", "zz", o), _bar("A", "1m", o, 5, "??"),
         _bar("B", "D", o - 33300), _bar("B", "D", o + 3 * 86400 + 7), _bar("B", "D", o + 2 * 86400)], BARS)
    got = sorted((r.symbol, r.bar_interval, r.slot_ts) for r in missing_periods(bars, cal).collect())
    assert got == [("A", "1m", o + 120), ("A", "1m", o + 180), ("A", "1m", o + 240), ("B", "D", o - 33300 + 86400)]
    g = {(r.slot_ts - o) // 60: r for r in session_grid(bars, cal).where("symbol = 'A' and slot_ts < %d" % (o + 3600)).collect()}
    assert sorted(g) == list(range(10))
    assert (g[0].volume, g[1].volume, g[2].volume) == (10.0, 15.0, 15.0) and g[2].missing and not g[1].missing and g[3].volume is None
    assert missing_periods(bars.where("false"), cal).count() == 0 and missing_periods(bars, cal.where("false")).count() == 0


def test_counter_resets_and_overlap(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("s", 0, 5), ("s", 10, 9), ("s", 25, 2), ("s", 40, 2)], "k string, t bigint, c bigint")
    inc = counter_increments(df, ["k"], "t", "c")
    assert [(r.t, r.increment, r.since) for r in inc.orderBy("t").collect()] == [(0, 5, None), (10, 4, 0), (25, 2, 10), (40, 0, 25)]
    x = spread_over_cells(inc.where("since is not null").withColumn("increment", F.col("increment").cast("double")), F.lit(0), F.lit(20), "since", "t", "increment")
    assert {(r.t, r.cell, round(r.increment, 4)) for r in x.collect()} == {(10, 0, 4.0), (25, 0, 1.3333), (25, 1, 0.6667), (40, 1, 0.0)}


def test_negative_volume_is_no_reading(spark):
    o = 1_760_000_400 - (1_760_000_400 + 19800) % 86400 + 33300
    day = (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=o + 19800)).date()
    cal = spark.createDataFrame([("NSE", day, o, o + 240, "regular")], "exchange string, session_date date, open_ts bigint, close_ts bigint, slot string")
    bars = spark.createDataFrame([_bar("A", "1m", o, 100), _bar("A", "1m", o + 60, 150), _bar("A", "1m", o + 120, -50), _bar("A", "1m", o + 180, 30), _bar("B", "D", o - 33300, -7)], BARS)
    g = sorted((r.symbol, r.slot_ts - o, r.missing, r.volume) for r in session_grid(bars, cal).collect())
    assert g == [("A", 0, False, 100.0), ("A", 60, False, 150.0), ("A", 120, False, 0.0), ("A", 180, False, 30.0), ("B", -33300, False, 0.0)]


def test_holes_come_from_the_increments(spark, monkeypatch):
    """Without the spreading no hole is found; without the reset at a session's
    end the night between two sessions would be one."""
    from quillbar.operators import regrid

    o = 1_760_000_400 - (1_760_000_400 + 19800) % 86400 + 33300
    day = (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=o + 19800)).date()
    cal = spark.createDataFrame([("NSE", day + dt.timedelta(days=k), o + k * 86400, o + k * 86400 + 600, "regular") for k in range(3)], "exchange string, session_date date, open_ts bigint, close_ts bigint, slot string")
    stamps = [o, o + 240, o + 86400 + 300, o + 86400 + 540]
    bars = spark.createDataFrame([_bar("A", "1m", t) for t in stamps] + [_bar("A", "D", o), _bar("A", "D", o + 2 * 86400)], BARS)
    got = lambda: sorted((r.bar_interval, r.slot_ts - o) for r in missing_periods(bars, cal).collect())
    whole = got()
    assert whole == [("1m", k) for k in (60, 120, 180, 86760, 86820, 86880)] + [("D", 86400 - 33300)]

    spread, differenced = regrid.spread_over_cells, regrid.counter_increments
    monkeypatch.setattr(regrid, "spread_over_cells", lambda rows, origin, step, start, end, amount: spread(rows.withColumn(start, rows[end]), origin, step, start, end, amount))
    assert got() == []
    monkeypatch.setattr(regrid, "spread_over_cells", spread)
    monkeypatch.setattr(regrid, "counter_increments", lambda r, group, at, counter, run=None: differenced(r, group, at, counter))
    assert len(got()) > len(whole)
