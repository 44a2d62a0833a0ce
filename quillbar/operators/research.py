"""Causal features, gating, evidence identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbar.operators.series import by, efficiency, full, midrank, trailing


def regime_features(long: DataFrame) -> DataFrame:
    """Means of 20 and 60 closes, momentum and volatility over 20, path
    efficiency over 20 and drawdown within 60; null until 60 closes are there."""
    w = by()
    d = efficiency(long.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1), 20)
    ready = F.count("close").over(trailing(w, 60)) == 60
    f = {
        "sma20": F.avg("close").over(trailing(w, 20)), "sma60": F.avg("close").over(trailing(w, 60)), "momentum": F.col("close") / F.lag("close", 20).over(w) - 1,
        "volatility": full(F.stddev_samp("_r"), 20, "_r", trailing(w, 20)) * (252**0.5), "efficiency": F.col("efficiency"),
        "drawdown": F.greatest(F.lit(0.0), 1 - F.col("close") / F.max("close").over(trailing(w, 60))),
    }
    return d.select("symbol", "day", "close", *[F.when(ready, c).alias(n) for n, c in f.items()])


def regimes(features: DataFrame) -> DataFrame:
    """Trend, volatility class and stress per day, from the day before, so that a
    decision never sees its own day. All three are unknown until the 90 feature
    rows before that day are there, to rank its volatility and drawdown among.
    A trend needs an efficient path, a gap of the means and momentum that agree;
    stress needs high volatility and a drawdown that is deep and rare."""
    rank = lambda c, name: midrank(features.select("symbol", "day", F.col(c).alias("close")).where("close is not null"), 90).select("symbol", "day", F.col("midrank").alias(name))
    j = features.join(rank("volatility", "vol_rank"), ["symbol", "day"], "left").join(rank("drawdown", "dd_rank"), ["symbol", "day"], "left")
    w = by()
    prev = lambda c: F.lag(c).over(w)
    gap = (prev("sma20") / prev("sma60") - 1) * 100
    momentum = prev("momentum") * 100
    trend = F.when(prev("efficiency") <= 0.20, "range").when(
        prev("efficiency") >= 0.30, F.when((gap >= 0.5) & (momentum >= 1), "up").when((gap <= -0.5) & (momentum <= -1), "down").otherwise("unknown")
    ).otherwise("unknown")
    high = prev("vol_rank") >= 90
    elevated = high & (prev("drawdown") * 100 >= 5) & (prev("dd_rank") >= 90)
    known = prev("vol_rank").isNotNull() & prev("dd_rank").isNotNull()
    shown = lambda c: F.when(known, c).otherwise("unknown")
    return j.select(
        "symbol", "day", shown(trend).alias("trend"), shown(F.when(high, "high").otherwise("normal")).alias("vol_class"),
        shown(F.when(elevated, "elevated").otherwise("normal")).alias("stress"),
    )


def relative_strength(long: DataFrame, bench: DataFrame, lookback: int) -> DataFrame:
    """100 * (own growth / benchmark growth - 1) over the lookback; null unless all days are shared."""
    j = long.select("symbol", "day", F.col("close").alias("s")).join(bench.select("day", F.col("close").alias("b")), "day")
    w = by()
    ok = F.count("*").over(trailing(w, lookback + 1)) == lookback + 1
    rs = ((F.col("s") / F.lag("s", lookback).over(w)) / (F.col("b") / F.lag("b", lookback).over(w)) - 1) * 100
    return j.select("symbol", "day", F.when(ok, rs).alias("rs"))


def unknown_and(*parts: Column) -> Column:
    """Conjunction in which an unknown part makes the whole unknown."""
    known, value = F.lit(True), F.lit(True)
    for p in parts:
        known, value = known & p.isNotNull(), value & F.coalesce(p, F.lit(False))
    return F.when(known, value)


def adjust(long: DataFrame, actions: DataFrame, cutoff: Column) -> DataFrame:
    """Prices times the factors of all corporate actions after the day and up to
    the cutoff. Factors are summed as logarithms from the newest back, and each
    day takes the sum that holds from it: one window instead of a range join."""
    a = actions.where(F.col("ex_date") <= cutoff).groupBy("symbol", F.col("ex_date").alias("day")).agg(F.sum(F.log("factor")).alias("_l"))
    u = long.select("symbol", "day", "close", F.lit(None).cast("double").alias("_l"), F.lit(1).alias("_o")).unionByName(a.select("symbol", "day", F.lit(None).cast("double").alias("close"), "_l", F.lit(0).alias("_o")))
    later = Window.partitionBy("symbol").orderBy(F.desc("day"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, -1)
    return u.withColumn("_f", F.coalesce(F.sum("_l").over(later), F.lit(0.0))).where("_o = 1").select("symbol", "day", "close", (F.col("close") * F.exp("_f")).alias("adjusted"))


def with_warmup(long: DataFrame, first_day: Column, rows: int) -> DataFrame:
    """Rows from the first day on, and as many before it as the features need."""
    w = by()
    at = F.min(F.when(F.col("day") >= first_day, F.col("_n"))).over(Window.partitionBy("symbol"))
    return long.withColumn("_n", F.row_number().over(w)).withColumn("_a", at).where(F.col("_n") >= F.col("_a") - rows).drop("_n", "_a")


def signal_modes(counts: DataFrame) -> DataFrame:
    """Days of a signal count: below half of its prior 7-day mean, nothing at all, or up from the day before."""
    w = by()
    mean7 = F.avg("n").over(w.rowsBetween(-7, -1))
    k = F.count("n").over(w.rowsBetween(-7, -1))
    return counts.select("symbol", "day", "n", F.when(k == 7, F.col("n") < mean7 / 2).alias("trough"), (F.col("n") == 0).alias("zero"), (F.col("n") > F.lag("n").over(w)).alias("uptick"))


def required_ranges(signals: DataFrame, before: int, after: int) -> DataFrame:
    """Days to fetch per symbol so that every signal has its lead-in and outcome, as merged ranges."""
    s = signals.select("symbol", F.date_sub("day", before).alias("lo"), F.date_add("day", after).alias("hi"))
    w = Window.partitionBy("symbol").orderBy("lo", "hi")
    top = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_new", F.when(top.isNull() | (F.col("lo") > F.date_add(top, 1)), 1).otherwise(0))
    s = s.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("symbol", "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("signals")).drop("_g")


def complete_only(signals: DataFrame, missing: DataFrame) -> DataFrame:
    """Signals without a missing price."""
    return signals.join(missing, ["symbol", "day"], "left_anti")


def identity(df: DataFrame, *cols: str) -> Column:
    """Content identity of a row: hash over its canonical JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def frontier(df: DataFrame, name: str, first: str, second: str) -> DataFrame:
    """Rows that no other row beats in one of two metrics while being at least
    equal in the other; equal rows stay together. The best second metric per value
    of the first is compared with the best before it, so rows never meet in pairs."""
    best = df.groupBy(first).agg(F.max(second).alias("_m"))
    better = F.max("_m").over(Window.orderBy(F.desc(first)).rowsBetween(Window.unboundedPreceding, -1))
    edge = best.withColumn("_p", better).where(F.col("_p").isNull() | (F.col("_m") > F.col("_p"))).select(first, F.col("_m").alias(second))
    return df.join(edge, [first, second], "left_semi").select(name, first, second)


def union_frontier(parts: DataFrame, key: list[str], origin: str) -> DataFrame:
    """One row per identity with all its origins."""
    return parts.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set(origin)), ",").alias("origins"), F.count("*").alias("n"))


def repetition(trades: DataFrame, cols: list[str]) -> DataFrame:
    """Fingerprints of executions and how often each occurs."""
    return trades.groupBy(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256).alias("fingerprint")).agg(F.count("*").alias("n")).where("n > 1")


def first_exit(signals: DataFrame, bars: DataFrame, stop: float, target: float, hold: int) -> DataFrame:
    """Entry at the next session's open; the first of stop (before target on the
    same bar; a gap fills at the open), target, or the close after ``hold``
    sessions. Each bar meets only the signals whose holding window it is in."""
    w = Window.partitionBy("symbol").orderBy("day")
    b = bars.withColumn("i", F.row_number().over(w))
    s = signals.join(b.select("symbol", "day", F.col("i").alias("i0")), ["symbol", "day"]).select("symbol", F.col("day").alias("signal_day"), "i0")
    legs = s.withColumn("i", F.explode(F.sequence(F.col("i0") + 1, F.col("i0") + hold)))
    j = legs.join(b, ["symbol", "i"])
    entry = F.first("open").over(Window.partitionBy("symbol", "signal_day").orderBy("i"))
    j = j.withColumn("entry", entry)
    sl, tp = F.col("entry") * (1 - stop), F.col("entry") * (1 + target)
    price = F.when(F.col("low") <= sl, F.least(F.col("open"), sl)).when(F.col("high") >= tp, F.greatest(F.col("open"), tp)).when(F.col("i") == F.col("i0") + hold, F.col("close"))
    why = F.when(F.col("low") <= sl, "stop").when(F.col("high") >= tp, "target").when(F.col("i") == F.col("i0") + hold, "time")
    x = j.withColumn("exit", price).withColumn("why", why).where("exit is not null")
    return x.groupBy("symbol", "signal_day").agg(F.min_by(F.struct("day", "entry", "exit", "why"), "i").alias("x")).select("symbol", "signal_day", F.col("x.day").alias("exit_day"), "x.entry", "x.exit", "x.why")
