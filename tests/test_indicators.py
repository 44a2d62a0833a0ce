from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from quillbar.functions import indicators as ind
from quillbar.functions import recursive as rec


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    n = 160
    c = 100 + np.cumsum(rng.normal(0, 1, n))
    pdf = pd.DataFrame({"symbol": "A", "exchange": "X", "interval": "5m", "timestamp": 1_700_000_000 + 300 * np.arange(n), "open": c - 0.2, "high": c + 1, "low": c - 1, "close": c, "volume": rng.integers(100, 1000, n)})
    return pdf, spark.createDataFrame(pd.concat([pdf, pdf.assign(symbol="B", close=pdf.close + 5, high=pdf.high + 5, low=pdf.low + 5, open=pdf.open + 5)])).cache()


def _col(df, name, out="value", **p):
    r = ind.apply(df, name, **p).where("symbol = 'A'").orderBy("timestamp").toPandas()[out]
    return r.astype(float).to_numpy()


def _rec(df, name, out=None, **p):
    return rec.apply(df, name, **p).where("symbol = 'A'").orderBy("timestamp").toPandas()[out or name].to_numpy()


def _same(a, b):
    np.testing.assert_allclose(a, np.asarray(b, float), rtol=1e-9, atol=1e-9)


def test_frames_against_pandas(sample):
    p, df = sample
    c, h, lo, v = p.close, p.high, p.low, p.volume
    _same(_col(df, "sma", period=14), c.rolling(14).mean())
    _same(_col(df, "stdev", period=14), c.rolling(14).std(ddof=0))
    _same(_col(df, "bbands", "out0", period=20), c.rolling(20).mean() + 2 * c.rolling(20).std(ddof=0))
    _same(_col(df, "roc", length=14), 100 * (c / c.shift(14) - 1))
    _same(_col(df, "williams_r", period=14), -100 * (h.rolling(14).max() - c) / (h.rolling(14).max() - lo.rolling(14).min()))
    _same(_col(df, "obv"), (np.sign(c.diff()).fillna(0) * v).cumsum())
    _same(_col(df, "wma", period=10), c.rolling(10).apply(lambda x: (x * np.arange(1, 11)).sum() / 55, raw=True))
    tp = (h + lo + c) / 3
    mad = tp.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True)
    _same(_col(df, "cci", period=20), (tp - tp.rolling(20).mean()) / (0.015 * mad))
    _same(_col(df, "aroon", "out0", period=25), h.rolling(26).apply(lambda x: 100 * (25 - (25 - np.flatnonzero(x == x.max())[-1])) / 25, raw=True))
    _same(_col(df, "linreg", period=14), c.rolling(14).apply(lambda x: np.polyval(np.polyfit(np.arange(14), x, 1), 13), raw=True))
    _same(_col(df, "vwma", period=14), (c * v).rolling(14).sum() / v.rolling(14).sum())
    _same(_col(df, "median", period=3), c.rolling(3).median())
    _same(_col(df, "hv", length=10), np.log(c / c.shift()).rolling(10).std() * math.sqrt(365) * 100)


def test_recurrences_against_pandas(sample):
    p, df = sample
    c, h, lo = p.close, p.high, p.low
    e = lambda x, n: x.ewm(span=n, adjust=False).mean()
    _same(_rec(df, "ema", period=14), e(c, 14))
    m = e(c, 12) - e(c, 26)
    _same(_rec(df, "macd", "macd_2"), m - e(m, 9))
    _same(_rec(df, "tema", period=14), 3 * e(c, 14) - 3 * e(e(c, 14), 14) + e(e(e(c, 14), 14), 14))
    tr = np.maximum(h - lo, np.maximum((h - c.shift()).abs(), (lo - c.shift()).abs())).fillna(h - lo)
    w = [None] * 160
    for i in range(13, 160):
        w[i] = tr[:14].mean() if i == 13 else (w[i - 1] * 13 + tr[i]) / 14
    _same(_rec(df, "atr", period=14), w)
    d = c.diff()
    u, dn = d.clip(lower=0), -d.clip(upper=0)
    a, b = u[1:15].mean(), dn[1:15].mean()
    want = [np.nan] * 14 + [100 - 100 / (1 + a / b)]
    for i in range(15, 160):
        a, b = (a * 13 + u[i]) / 14, (b * 13 + dn[i]) / 14
        want.append(100 - 100 / (1 + a / b))
    _same(_rec(df, "rsi", period=14), want)


def test_state_does_not_leak_between_series_or_batches(spark, sample):
    _, df = sample
    names = list(rec.REGISTRY)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        got = []
        for n in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got.append(rec.apply(df, names).where("symbol = 'B'").orderBy("timestamp").toPandas())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    pd.testing.assert_frame_equal(*got)
    alone = rec.apply(df.where("symbol = 'B'"), names).orderBy("timestamp").toPandas()
    pd.testing.assert_frame_equal(alone, got[0])


@pytest.mark.parametrize("lib", [ind, rec])
def test_the_future_changes_nothing(sample, lib):
    """Rows after a bar never move its values (the displaced cloud's own look-ahead output aside)."""
    p, df = sample
    cut = int(p.timestamp[100])
    for name in ["sma", "macd", "psar", "supertrend", "cci", "kama", "aroon", "flip", "exrem", "valuewhen", "rwi", "mode"]:
        if name in lib.REGISTRY:
            a = lib.apply(df, name).where(f"timestamp <= {cut}").orderBy("symbol", "timestamp").toPandas()
            b = lib.apply(df.where(f"timestamp <= {cut}"), name).orderBy("symbol", "timestamp").toPandas()
            pd.testing.assert_frame_equal(a, b)


def test_supertrend_and_psar_follow_a_trend(spark):
    n = 60
    c = np.concatenate([np.linspace(100, 160, n // 2), np.linspace(160, 90, n // 2)])
    pdf = pd.DataFrame({"symbol": "A", "exchange": "X", "interval": "D", "timestamp": np.arange(n), "open": c, "high": c + 1, "low": c - 1, "close": c, "volume": 5})
    r = rec.apply(spark.createDataFrame(pdf), ["supertrend", "psar"]).orderBy("timestamp").toPandas()
    assert r.supertrend_1[25] == 1 and r.supertrend_1[59] == -1
    assert (r.psar[10:28] < c[10:28]).all() and r.psar[50] > c[50]
