"""Implausible spikes, stuck values and impossible readings in bar series.

Per series a local-level state-space model runs over the logarithms of close,
high, low and volume: a Kalman filter forecasts the next reading, a reading
whose standardised innovation passes the gate does not update the state, and
the variance adapts to what passed. A fourth such reading in a row makes the
move lasting: the level becomes the median of the four, and they are judged
again from it.

The filter runs in both directions. A reading is a spike if its standardised
innovations of both pass the limit on the same side: it is far from what came
before and from what came after, in terms of both scales. A move to a new level
is far from one side only, a burst has widened the scale of one side, and an
excursion of more than three readings is a level of its own. Prices are a walk
with little noise, so the forecast is about the last accepted reading; volumes
are mostly noise around a slow level, and only upward ones count.

A stuck series is one whose innovation variance vanishes: over windows of six
bars the squared one-step innovations of close, high and low sum to nothing.

Scale: series are cut into blocks of ``BLOCK`` bars by exact position, with
``MARGIN`` bars lent from both neighbours, so a series of any length is spread
over tasks. The margin covers the runs and some nine memories of the filter's
variance. A task walks the blocks of about ``TOGETHER`` bars side by side, one
lane per block, quantity and direction, so Python steps once for all of them.

Defined results: only the latest version of a bar counts; nulls are no
reading; a series of fewer than three bars can only have impossible readings;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbar.operators.ranking import blocks, ranked
from quillbar.sources.tables import latest_bars

BLOCK, MARGIN = 1000, 128
#: Bars whose blocks are walked together.
TOGETHER = 100_000
#: Standardised innovation from which the filter withholds an update.
GATE = 5.0
#: Standardised innovations, in both directions, from which a price or a volume is a case.
PRICE_LIMIT, VOLUME_LIMIT = 9.0, 7.0
#: Readings in a row beyond the gate after which a move is lasting.
SHORT = 3
#: Variance of the level's steps and of the noise, in units of the model's scale.
PRICE_MODEL, VOLUME_MODEL = (1.0, 0.01), (0.02, 1.0)
#: Weight of a new innovation in the variance, and its lowest value in units of the typical scale.
ADAPT, FLOOR = 0.05, 0.5
RUN = 6


def impossible(close: np.ndarray, high: np.ndarray, low: np.ndarray, volume: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Readings that contradict themselves. ``null``: (n, 3) nulls of close, high, low (a null is no reading); volume has NaN for null."""
    with np.errstate(invalid="ignore"):
        bad = volume < 0
        for i, x in enumerate((close, high, low)):
            bad |= ~null[:, i] & ~(np.isfinite(x) & (x > 0))
        bad |= ~null[:, 1] & ~null[:, 2] & (high < low)
        bad |= ~null[:, 0] & ((~null[:, 2] & (close < low)) | (~null[:, 1] & (close > high)))
    return bad


def stuck(close: np.ndarray, high: np.ndarray, low: np.ndarray, volume: np.ndarray) -> np.ndarray:
    """Bars in windows of ``RUN`` bars, each with volume, over which the variance of the one-step innovations of all three prices vanishes."""
    n = len(close)
    out = np.zeros(n, bool)
    if n <= RUN:
        return out
    with np.errstate(invalid="ignore"):
        power = np.diff(close) ** 2 + np.diff(high) ** 2 + np.diff(low) ** 2
        power[~(np.isfinite(power) & (volume[1:] > 0))] = np.inf
    variance = np.lib.stride_tricks.sliding_window_view(power, RUN).sum(axis=1) / RUN
    for k in range(RUN):
        out[1 + k : n - RUN + 1 + k] |= variance == 0
    return out


def kalman_lanes(y: np.ndarray, n: np.ndarray, start: np.ndarray, scale: np.ndarray, model: tuple[float, float], gate: float = GATE) -> np.ndarray:
    """Standardised innovations (step, lane) of readings beyond the gate, 0 for the
    others. ``y``: the readings of each lane in order; ``n``: how many, falling
    from lane to lane; ``start``: first level; ``scale``: typical size of a move."""
    q, r = model
    out = np.zeros(y.shape)
    if not y.size:
        return out
    live = np.searchsorted(-n, -np.arange(len(y)), side="left")
    m, v = start.astype(float).copy(), scale.astype(float) ** 2
    low, p, run = FLOOR**2 * v, v.copy(), np.zeros(len(n), np.int64)
    for t, k in enumerate(live):
        x, vk = y[t, :k], v[:k]
        ahead = p[:k] + q * vk
        s2 = ahead + r * vk
        nu = x - m[:k]
        d = nu * nu
        hit = d > gate * gate * s2
        lasting = hit & (run[:k] >= SHORT)
        if lasting.any():
            at = np.flatnonzero(lasting)
            level = np.median(y[t - SHORT : t + 1, at], axis=0)
            m[at], ahead[at] = level, vk[at]
            s2[at] = ahead[at] + r * vk[at]
            nu[at] = x[at] - level
            d[at] = nu[at] ** 2
            hit[at] = d[at] > gate * gate * s2[at]
            run[at] = 0
            for j in range(1, SHORT + 1):  # the readings of the run are judged again from the new level
                e = y[t - j, at] - level
                out[t - j, at] = np.where(e * e > gate * gate * s2[at], e / np.sqrt(s2[at]), 0.0)
        gain = np.where(hit, 0.0, ahead / s2)
        out[t, :k] = np.where(hit, nu / np.sqrt(s2), 0.0)
        m[:k] += gain * nu
        p[:k] = (1.0 - gain) * ahead
        seen = (1.0 - ADAPT) * vk + ADAPT * np.minimum(d * vk / s2, 9.0 * vk)
        v[:k] = np.where(hit, vk, np.maximum(low[:k], seen))
        run[:k] = np.where(hit, run[:k] + 1, 0)
    return out


def two_sided(x: np.ndarray, group: np.ndarray, model: tuple[float, float], unit: float, least: float, settle: bool) -> np.ndarray:
    """Signed standardised innovation of every reading, the smaller of the two
    directions, 0 where they disagree. ``group``: number of the block of each
    reading, not falling; ``unit``: the model's scale in units of a typical move;
    ``least``: typical move of a block with too few moves;
    ``settle``: the backward level starts at a median, not at the last reading
    (an excursion at the very end never came back)."""
    out = np.zeros(len(x))
    if not len(x):
        return out
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n = np.diff(np.r_[first, len(x)])
    by = np.argsort(-n, kind="stable")
    i = 0
    while i < len(by):
        take = by[i:]
        take = take[n[take] * 2 >= n[take[0]]]  # lanes of like length: little padding
        i += len(take)
        long = n[take]
        step = np.arange(long[0])[:, None]
        inside = step < long
        at = np.where(inside, first[take] + step, 0)
        back = np.where(inside, first[take] + long - 1 - step, 0)
        y = np.where(inside, x[at], np.nan)
        moves = np.abs(np.diff(y, axis=0))
        moves[~(moves > 0)] = np.nan
        known = np.isfinite(moves).sum(axis=0) >= 5
        scale = np.full(len(take), least)
        if known.any():
            scale[known] = 1.4826 * np.nanmedian(moves[:, known], axis=0)
        behind = np.where(inside, x[back], np.nan)
        start, end = np.nanmedian(y[:5], axis=0), np.nanmedian(behind[:5], axis=0) if settle else behind[0]
        ahead = kalman_lanes(y, long, start, unit * scale, model)
        after = kalman_lanes(behind, long, end, unit * scale, model)
        z = np.zeros(len(x))
        z[back[inside]] = after[inside]
        w, z = ahead[inside], z[at[inside]]
        out[at[inside]] = np.where(np.sign(w) == np.sign(z), np.sign(w) * np.minimum(np.abs(w), np.abs(z)), 0.0)
    return out


def _price_cases(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    return np.abs(two_sided(x, group, PRICE_MODEL, 1.0, 2e-3, settle=False)) >= PRICE_LIMIT


def _volume_cases(v: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of volumes above zero; a move between two noisy readings has twice their variance."""
    return two_sided(np.log1p(v), group, VOLUME_MODEL, np.sqrt(0.5), 0.7, settle=True) >= VOLUME_LIMIT


def price_cases(x: np.ndarray) -> np.ndarray:
    """Spikes of one log price series."""
    return _price_cases(x, np.zeros(len(x), np.int64)) if len(x) > 2 else np.zeros(len(x), bool)


def volume_cases(v: np.ndarray) -> np.ndarray:
    """Spikes of the volumes of one series (NaN: no reading)."""
    out = np.zeros(len(v), bool)
    use = np.flatnonzero(v > 0)
    if len(use) > 2:
        out[use] = _volume_cases(v[use], np.zeros(len(use), np.int64))
    return out


def block_cases(close: np.ndarray, high: np.ndarray, low: np.ndarray, volume: np.ndarray, null: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(impossible, stuck, spike) of the bars of whole blocks in order."""
    bad = impossible(close, high, low, volume, null)
    still = np.zeros(len(close), bool)
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > RUN:
            still[a:b] = stuck(close[a:b], high[a:b], low[a:b], volume[a:b])
    spike = np.zeros(len(close), bool)
    for i, x in enumerate((close, high, low)):
        use = np.flatnonzero(~bad & ~null[:, i])
        spike[use] |= _price_cases(np.log(x[use]), group[use])
    with np.errstate(invalid="ignore"):
        use = np.flatnonzero(~bad & (volume > 0))
    spike[use] |= _volume_cases(volume[use], group[use])
    return bad, still, spike & ~bad


_BUCKET = {"1m": 86400, "5m": 5 * 86400, "15m": 15 * 86400, "1h": 60 * 86400, "D": 2000 * 86400}


def implausible_bars(bars: DataFrame) -> DataFrame:
    """symbol, exchange, bar_interval, bar_ts, why (impossible, stuck, spike)."""
    live = latest_bars(bars, "close", "high", "low", "volume")
    keys = ["symbol", "exchange", "interval"]
    width = F.lit(86400)
    for k, w in _BUCKET.items():
        width = F.when(F.col("interval") == k, F.lit(w)).otherwise(width)
    r = ranked(live, keys, [F.col("timestamp")], F.floor(F.col("timestamp") / width))

    key = [*keys, "block"]

    def found(g: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        f = lambda c: g[c].to_numpy(dtype=float, na_value=np.nan)
        null = np.column_stack([g[f"{c}_null"].to_numpy(bool) for c in ("close", "high", "low")])
        bad, still, spike = block_cases(f("close"), f("high"), f("low"), f("volume"), null, group)
        hit = (bad | still | spike) & g["core"].to_numpy(bool)
        why = np.where(bad, "impossible", np.where(still, "stuck", "spike"))[hit]
        h = g.loc[hit, ["symbol", "exchange", "interval", "timestamp"]]
        return h.set_axis(["symbol", "exchange", "bar_interval", "bar_ts"], axis=1).assign(why=why)

    def numbered(g: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(g), bool)
        for c in key:
            x = g[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) < TOGETHER:
                continue
            g = pd.concat(held, ignore_index=True)
            group = numbered(g)
            whole = int(np.searchsorted(group, group[-1]))  # the last block may go on in the next batch
            if whole:
                yield found(g[:whole], group[:whole])
            held = [g[whole:]]
        if held and sum(map(len, held)):
            g = pd.concat(held, ignore_index=True)
            yield found(g, numbered(g))

    parts = blocks(r, "rank", BLOCK, MARGIN)
    for c in ("close", "high", "low"):
        parts = parts.withColumn(f"{c}_null", F.col(c).isNull())
    return parts.repartition(*key).sortWithinPartitions(*key, "timestamp").mapInPandas(run, "symbol string, exchange string, bar_interval string, bar_ts bigint, why string")
