from __future__ import annotations

import datetime as dt
import random

from quillbar.operators.rolling import rolling_totals

D = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)


def _run(spark, rows, periods=(7, 30)):
    df = spark.createDataFrame(rows, "symbol string, exchange string, day date, volume bigint, close double, age int")
    return {(r.symbol, r.day): r for r in rolling_totals(df, ["symbol", "exchange"], "day", "volume", "close", periods).collect()}


def test_against_plain_loop(spark):
    random.seed(4)
    rows = [("A" if random.random() < 0.7 else "B", "X", D(random.randrange(0, 120)), random.choice([None, 5, 7]), random.choice([None, 1.5, 2.5, float("nan")]), 0) for _ in range(150)]
    got = _run(spark, rows)
    for s in ("A", "B"):
        mine = [r for r in rows if r[0] == s]
        lo, hi = min(r[2] for r in mine), max(r[2] for r in mine)
        assert len([k for k in got if k[0] == s]) == (hi - lo).days + 1
        for i in range((hi - lo).days + 1):
            day = lo + dt.timedelta(days=i)
            for n in (7, 30):
                w = [r for r in mine if 0 <= (day - r[2]).days < n]
                c = [r[4] for r in w if r[4] is not None and r[4] == r[4]]
                x = got[(s, day)]
                assert x[f"volume_{n}d"] == sum(r[3] or 0 for r in w)
                assert x[f"close_avg_{n}d"] == (round(sum(c) / len(c), 6) if c else None)


def test_single_day_and_empty(spark):
    assert _run(spark, [("A", "X", D(0), None, None, 1)])[("A", D(0))].volume_7d == 0
    assert _run(spark, []) == {}
    assert _run(spark, [(None, "X", D(0), 1, 1.0, 1)]) == {}
