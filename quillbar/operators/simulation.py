"""Row-by-row simulations that are not indicators: option straddles, position
and account risk, fold plans, parameter grids."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def straddle_days(ticks: DataFrame, roll: float) -> DataFrame:
    """Short straddle per (symbol, day): entered at the first priced bar, rolled
    when the at-the-money strike has moved by ``roll`` from the entry and the old
    and new legs are priced, settled on the last bar.

    Input: symbol, day, ts, atm, price (of the straddle at the current strike),
    held (price of the straddle at the strike of entry, null if unpriced). Output
    per bar: realised and open result of the day. A group is one day of a symbol."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts", kind="stable")
        entry = strike = None
        real, last, out = 0.0, 0.0, []
        n = len(g)
        for i, (atm, price) in enumerate(zip(g["atm"].tolist(), g["price"].tolist())):
            ok = price == price and price is not None
            if entry is None:
                if ok:
                    entry, strike = price, atm
            elif ok:
                last = entry - price
                if abs(atm - strike) >= roll and i < n - 1:
                    real += last
                    entry, strike, last = price, atm, 0.0
            if i == n - 1 and entry is not None:
                real, last = real + last, 0.0
            out.append((real, last))
        r = g[["symbol", "day", "ts"]].copy()
        r[["realized", "open_result"]] = pd.DataFrame(out, index=r.index)
        return r

    return ticks.groupBy("symbol", "day").applyInPandas(run, "symbol string, day date, ts bigint, realized double, open_result double")


def cumulative_days(days: DataFrame) -> DataFrame:
    """Adds up the settled results over days."""
    d = days.groupBy("symbol", "day").agg(F.max_by("realized", "ts").alias("result"))
    return d.withColumn("cumulative", F.sum("result").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


#: What a position's watch is set to, beside its key: a side of BUY or SELL; prices
#: that are not above zero and finite are not set; trail_mode none, continuous or stepped.
RISK = ("side", "entry", "stop", "target", "trail_mode", "trail_trigger", "trail_step")


def _price(c: str) -> Column:
    """A price above zero and finite, else null."""
    return F.when((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.col(c))


def position_risk(ticks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Ticks of positions (keys, order, price, and the columns ``RISK``, the same
    in all ticks of a position): the stop in force and the exit (stop, target)
    where it happens; after the exit the rows have neither, and neither has a
    tick without a usable price.

    The best price so far never worsens, and the trailed stop only follows it, so
    both are running extremes and the exit is the first row beyond a level:
    windows say it all. The trail moves before the stop is tested, the stop is
    tested before the target. Without a usable entry nothing trails."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    d = ticks.withColumn("_p", _price("price")).withColumn("_e", _price("entry")).withColumn("_s", _price("stop")).withColumn("_t", _price("target")).withColumn("_d", sign)
    best = F.max(F.greatest(F.col("_d") * F.col("_p"), F.when(F.col("_p").isNotNull(), F.col("_d") * F.col("_e")))).over(upto)
    d = d.withColumn("_best", best).withColumn("_gain", F.greatest(F.lit(0.0), F.col("_best") - F.col("_d") * F.col("_e")))
    trigger = F.greatest(F.lit(0.0), F.coalesce("trail_trigger", F.lit(0.0)))
    armed = (F.col("trail_step") > 0) & (F.col("trail_step") < float("inf")) & (F.col("_gain") > 0) & (F.col("_gain") >= trigger)
    steps = F.floor(F.col("_gain") / F.when(trigger > 0, trigger))
    wish = F.when(F.col("trail_mode") == "continuous", F.col("_best") - F.col("trail_step")).when(
        (F.col("trail_mode") == "stepped") & (steps > 0), F.col("_d") * F.col("_s") + steps * F.col("trail_step")
    )
    level = F.greatest(F.col("_d") * F.col("_s"), F.when(armed & wish.isNotNull(), F.least(wish, F.col("_best"))))
    d = d.withColumn("_level", level)
    at = F.col("_d") * F.col("_p")
    why = F.when(at <= F.col("_level"), "stop").when(at >= F.col("_d") * F.col("_t"), "target")
    d = d.withColumn("_why", why).withColumn("_out", F.coalesce(F.count("_why").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0)
    seen = ~F.col("_out") & F.col("_p").isNotNull()
    return d.select(*keys, *order, F.when(seen, F.abs("_level")).alias("stop_level"), F.when(seen, F.col("_why")).alias("exit"))


class RiskState:
    """The same rule tick by tick: best price so far and whether the position is out."""

    def __init__(self, state: tuple[float | None, bool] = (None, False)) -> None:
        self.best, self.out = state

    @staticmethod
    def _usable(x: float | None) -> float | None:
        return x if x is not None and math.isfinite(x) and x > 0 else None

    def tick(self, price: float | None, side: str, entry: float | None, stop: float | None, target: float | None, mode: str | None, trigger: float | None, step: float | None) -> tuple[float | None, str | None]:
        """(stop in force, exit) of one tick."""
        p = self._usable(price)
        if p is None or self.out:
            return None, None
        d = 1.0 if side == "BUY" else -1.0
        e, s, t = self._usable(entry), self._usable(stop), self._usable(target)
        known = [x for x in (self.best, d * p, None if e is None else d * e) if x is not None]
        self.best = max(known)
        levels = [] if s is None else [d * s]
        gain = 0.0 if e is None else max(0.0, self.best - d * e)
        trigger = max(0.0, trigger or 0.0)
        if step is not None and math.isfinite(step) and step > 0 and gain > 0 and gain >= trigger:
            if mode == "continuous":
                levels.append(min(self.best - step, self.best))
            elif mode == "stepped" and trigger > 0 and s is not None and gain >= trigger:
                levels.append(min(d * s + math.floor(gain / trigger) * step, self.best))
        level = max(levels, default=None)
        why = "stop" if level is not None and d * p <= level else "target" if t is not None and d * p >= d * t else None
        self.out = why is not None
        return None if level is None else abs(level), why


def risk_monitor(ticks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rule of the tick-stream monitor over stored ticks: streams each
    position's sorted ticks through ``RiskState``, one state at a time."""
    cols = [*keys, *order, "price", *RISK]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, rule = None, RiskState()
        for b in batches:
            out = []
            plain = b[["price", *RISK]].astype(object).where(b[["price", *RISK]].notna(), None)
            for k, x in zip(b[keys].itertuples(index=False, name=None), plain.itertuples(index=False, name=None)):
                if k != who:
                    who, rule = k, RiskState()
                out.append(rule.tick(*x))
            r = b[[*keys, *order]].copy()
            r["stop_level"] = pd.Series([x for x, _ in out], index=r.index, dtype="float64")
            r["exit"] = [y for _, y in out]
            yield r

    kinds = ", ".join(f"{c} {ticks.schema[c].dataType.simpleString()}" for c in [*keys, *order])
    src = ticks.select(*cols).where(" and ".join(f"`{c}` is not null" for c in keys))
    return src.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, stop_level double, exit string")


def account_risk(pnl: DataFrame, lock_at: float, step: float, stop: float, target: float) -> DataFrame:
    """Peak, trough, locked floor and trigger of an account's running result
    (account, ts, pnl): once the peak reaches ``lock_at``, the floor follows it at
    a distance of ``step`` and never falls."""
    w = Window.partitionBy("account").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = pnl.withColumn("peak", F.max("pnl").over(w)).withColumn("trough", F.min("pnl").over(w))
    d = d.withColumn("floor", F.when(F.col("peak") >= lock_at, F.greatest(F.lit(0.0), F.col("peak") - step)))
    p = F.col("pnl")
    return d.withColumn("trigger", F.when(p <= -stop, "stop").when(F.col("floor").isNotNull() & (p <= F.col("floor")), "lock").when(p >= target, "target"))


def trail_to_entry(positions: DataFrame) -> DataFrame:
    """What moving the stop to the entry would do: moves, not_improving, through_price or no_entry."""
    e, s, p = F.col("entry"), F.col("stop"), F.col("price")
    long = F.col("side") == "BUY"
    return positions.withColumn(
        "action",
        F.when(e.isNull(), "no_entry").when(F.when(long, p <= e).otherwise(p >= e), "through_price").when(F.when(long, s >= e).otherwise(s <= e), "not_improving").otherwise("moves"),
    )


def folds(days: DataFrame, share: float = 0.8, parts: int = 3, purge: int = 5) -> DataFrame:
    """Expanding folds over sessions: of the development share the first half
    always trains, the rest is cut into ``parts`` test folds in order; the last
    ``purge`` sessions before a test fold train nothing. The remainder is held out."""
    w = Window.orderBy("day")
    d = days.select("day").distinct().withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    dev = F.floor(F.col("n") * share)
    half = F.floor(dev / 2)
    size = F.ceil((dev - half) / parts)
    role = F.when(F.col("i") >= dev, "holdout").when(F.col("i") < half, "initial").otherwise("test")
    fold = F.when(role == "test", F.floor((F.col("i") - half) / size) + 1)
    d = d.select("day", "i", role.alias("role"), fold.cast("int").alias("fold"))
    nxt = F.lead("fold", purge).over(Window.orderBy("day"))
    return d.withColumn("purged", F.coalesce(nxt, F.lit(-1)) > F.coalesce("fold", F.lit(0)))


def grid(spark, **values: list) -> DataFrame:
    """All combinations of parameter values, numbered. The grid is the caller's
    list of candidates and is made on the driver."""
    names = list(values)
    rows = [(i, *c) for i, c in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, ["candidate", *names])
