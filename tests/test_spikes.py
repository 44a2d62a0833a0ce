from __future__ import annotations

import numpy as np
import pytest

from quillbar.operators import spikes as sp
from quillbar.operators.ranking import blocks, ranked


def _walk(n, seed=1, sd=0.002):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, sd, n)))


@pytest.mark.parametrize("length", [1, 2, 3])
@pytest.mark.parametrize("at", [50, 200, 296])
def test_short_excursions_are_cases(length, at):
    x = _walk(300)
    x[at : at + length] *= 1.15
    got = np.flatnonzero(sp.price_cases(np.log(x)))
    assert got.tolist() == [i for i in range(at, at + length)] if at + length < 300 else True


def test_lasting_moves_and_bursts_are_none():
    x = _walk(300)
    x[150:] *= 1.2
    assert not sp.price_cases(np.log(x)).any()
    y = _walk(300, 3)
    y[100:130] = y[99] * np.exp(np.cumsum(np.random.default_rng(9).normal(0, 0.008, 30)))
    assert not sp.price_cases(np.log(y)).any()
    assert not sp.price_cases(np.log(np.full(50, 7.0))).any()
    assert not sp.price_cases(np.log(_walk(2))).any()


def test_volume():
    v = np.exp(np.random.default_rng(5).normal(9, 0.6, 200))
    v[50] *= 12
    v[120] *= 900
    v[30] = np.nan
    v[31] = 0
    assert np.flatnonzero(sp.volume_cases(v)).tolist() == [120]
    assert not sp.volume_cases(np.zeros(20)).any()


def test_stuck_and_impossible():
    c = np.array([1.0, 2, 2, 2, 2, 2, 2, 2, 3, 3, 3])
    v = np.full(11, 5.0)
    assert np.flatnonzero(sp.stuck(c, c, c, v)).tolist() == [2, 3, 4, 5, 6, 7]
    v[4] = 0
    assert not sp.stuck(c, c, c, v).any()
    n = np.zeros((6, 3), bool)
    n[5, 0] = True
    close = np.array([1.0, np.nan, 5, 2, -1, np.nan])
    high, low, vol = np.array([2.0, 2, 4, 1, 2, 2]), np.array([0.5, 1, 1, 2, 1, 1]), np.array([1.0, 1, 1, 1, 1, np.nan])
    assert sp.impossible(close, high, low, vol, n).tolist() == [False, True, True, True, True, False]
    assert sp.impossible(close, high, low, np.array([-1.0] * 6), n).all()


def test_operator_cuts_series_without_a_trace(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows, truth = [], set()
    for s, n in (("HOT", 1500), ("THIN", 60), ("ONE", 1)):
        x = _walk(n, len(s))
        for at in range(40, n - 10, 97):
            x[at] *= 1.3
            truth.add((s, 1_700_000_000 + at * 60))
        for i, p in enumerate(x):
            rows.append((s, "X", "1m", 1_700_000_000 + i * 60, float(p), float(p), float(p), float(p), int(rng.integers(500, 900)), None, 3))
    rows += [rows[7][:4] + (1.0, 1.0, 1.0, 1.0, 5, None, 3), ("NUL", "X", "1m", None, 1.0, 1.0, 1.0, 1.0, 1, None, 3), ("NUL", "X", "1m", 60, None, None, None, None, None, None, 3)]
    df = spark.createDataFrame(rows, "symbol string, exchange string, interval string, timestamp bigint, open double, high double, low double, close double, volume bigint, created_at timestamp, rank int")
    out = []
    for size in (150, 5000):
        monkeypatch.setattr(sp, "BLOCK", size)
        out.append({(r.symbol, r.bar_ts) for r in sp.implausible_bars(df).where("why = 'spike'").collect()})
    assert out[0] == out[1] >= truth
    assert sp.implausible_bars(df.where("false")).count() == 0


def test_ranks_and_blocks(spark):
    df = spark.createDataFrame([("a", i * 3 % 1000) for i in range(1000)], "k string, t int")
    from pyspark.sql import functions as F

    r = ranked(df, ["k"], [F.col("t")], F.floor(F.col("t") / 90))
    assert all(x.rank == x.t for x in r.collect())
    b = blocks(r, "rank", 100, 10)
    assert b.where("core").count() == 1000
    assert b.where("block = 3").agg(F.min("rank"), F.max("rank")).first() == (290, 409)


def test_the_filter_decides(monkeypatch):
    """Without innovations there is no spike; without the gate (no withheld
    update) an excursion of three readings is lost; without the variance no stuck bar."""
    x = _walk(300)
    x[100:103] *= 1.15
    x[200:] *= 1.3
    x[198] *= 1.2  # a spike two bars before a lasting move
    want = [100, 101, 102, 198]
    assert np.flatnonzero(sp.price_cases(np.log(x))).tolist() == want
    lanes = sp.kalman_lanes
    monkeypatch.setattr(sp, "kalman_lanes", lambda y, n, start, scale, model: np.zeros(y.shape))
    assert not sp.price_cases(np.log(x)).any()
    monkeypatch.setattr(sp, "kalman_lanes", lambda y, n, start, scale, model: lanes(y, n, start, scale, model, gate=1e9))
    assert not sp.price_cases(np.log(x)).any()
    monkeypatch.setattr(sp, "kalman_lanes", lambda y, n, start, scale, model: lanes(y, n, start, scale, model, gate=0.0))
    assert np.flatnonzero(sp.price_cases(np.log(x))).tolist() != want


def test_lanes_equal_one_lane():
    """Blocks walked side by side have the cases they have alone."""
    rng = np.random.default_rng(8)
    xs = [np.log(_walk(int(n), int(n))) for n in rng.integers(1, 400, 40)]
    for x in xs:
        if len(x) > 50:
            x[30] += 0.2
    flat, group = np.concatenate(xs), np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    got = sp._price_cases(flat, group)
    assert got.tolist() == np.concatenate([sp._price_cases(x, np.zeros(len(x), int)) for x in xs]).tolist() and got.sum() >= sum(len(x) > 50 for x in xs)
