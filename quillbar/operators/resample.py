"""Resampling of bars and ticks onto coarser periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbar.functions.intervals import OPEN_SECONDS, bucket_start, parse_interval


def fold_bars(bars: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Open, high, low, close, volume, open interest per key: first, highest,
    lowest, last, sum, last. ``order`` must be total within a key."""
    return bars.groupBy(*keys).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"), F.max_by("oi", order).alias("oi"),
    )


def resample(bars: DataFrame, interval: str, open_seconds: int = OPEN_SECONDS) -> DataFrame:
    """Bars of any interval from the stored 1m or D bars (symbol, exchange,
    timestamp, ...). Native intervals come back as stored; an invalid interval
    gives no rows."""
    i = parse_interval(interval)
    keys = ["symbol", "exchange"]
    cols = [*keys, "timestamp", "open", "high", "low", "close", "volume", "oi"]
    if i is None:
        return bars.where(F.lit(False)).select(*cols)
    src = bars.where(F.col("interval") == i.source)
    if i.native:
        return src.select(*cols)
    return fold_bars(src.withColumn("bucket", bucket_start(F.col("timestamp"), i, open_seconds)), [*keys, "bucket"], F.col("timestamp")).withColumnRenamed(
        "bucket", "timestamp"
    ).select(*cols)


def get_ohlcv(bars: DataFrame, symbol: str, exchange: str, interval: str, lower: int, upper: int) -> DataFrame:
    """Bars of one series in [lower, upper) at any interval, computed from the
    stored source. The predicates on series and source reach the scan; the range
    is applied to the computed bars, whose buckets may begin before their rows."""
    one = bars.where((F.col("symbol") == symbol.upper()) & (F.col("exchange") == exchange))
    return resample(one, interval).where((F.col("timestamp") >= lower) & (F.col("timestamp") < upper))


#: Intervals one call may ask for; bounds what is broadcast.
MOST_INTERVALS = 100


def available_intervals(catalog: DataFrame, intervals: list[str]) -> DataFrame:
    """Which intervals are usable per instrument: those whose source is stored. The
    intervals are a literal list of the caller, at most ``MOST_INTERVALS``."""
    if len(intervals) > MOST_INTERVALS:
        raise ValueError(f"at most {MOST_INTERVALS} intervals at once")
    pairs = [(t, i.source) for t in intervals if (i := parse_interval(t))]
    want = catalog.sparkSession.createDataFrame(pairs, "wanted string, interval string")
    return catalog.select("symbol", "exchange", "interval").distinct().join(F.broadcast(want), "interval").select("symbol", "exchange", "wanted")


def regrid_from_finer(bars: DataFrame, step: int, open_seconds: int = OPEN_SECONDS) -> DataFrame:
    """Coarser bars of a session in which readings before the open fold into its first bucket."""
    day = F.floor((F.col("timestamp") + 19800) / 86400) * 86400 - 19800
    start = day + open_seconds
    at = F.greatest(F.col("timestamp"), start)
    b = bars.withColumn("bucket", (start + F.floor((at - start) / step) * step).cast("bigint"))
    return fold_bars(b, ["symbol", "exchange", "bucket"], F.col("timestamp"))


def open_stamped(ts: Column, step: int) -> Column:
    """The opening stamp of a bar that was stamped at its close."""
    return (F.floor((ts - 1) / step) * step).cast("bigint")


def tick_bars(ticks: DataFrame, span_seconds: int) -> DataFrame:
    """Tumbling bars from ticks (symbol, us, event_id, price, size)."""
    span = span_seconds * 1_000_000
    o = F.struct("us", "event_id")
    return ticks.withColumn("bucket", (F.floor(F.col("us") / span) * span_seconds).cast("bigint")).groupBy("symbol", "bucket").agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("n"),
    )


def last_of_period(series: DataFrame, period: Column, key: str = "symbol", day: str = "day", value: str = "close") -> DataFrame:
    """Last observed day and value per period."""
    return series.groupBy(key, period.alias("period")).agg(F.max(day).alias("last_day"), F.max_by(value, day).alias("last_value"))


def rebalance_dates(days: DataFrame, rule: str) -> DataFrame:
    """Last session of every month, quarter or year, without the very first session."""
    trunc = {"monthly": "month", "quarterly": "quarter", "yearly": "year"}[rule]
    last = days.select("day").distinct().groupBy(F.date_trunc(trunc, "day").alias("p")).agg(F.max("day").alias("day"), F.min("day").alias("first"))
    start = days.agg(F.min("day")).scalar()
    return last.where(F.col("day") != start).select("day")


def last_dates(days: DataFrame, n: int, key: str = "symbol", day: str = "day") -> DataFrame:
    """Rows of the last n distinct dates that are present per key."""
    w = Window.partitionBy(key).orderBy(F.desc(day))
    return days.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= n).drop("_r")


def thin(series: DataFrame, key: str, order: str, points: int = 300) -> DataFrame:
    """Every k-th row, k so that about ``points`` remain."""
    w = Window.partitionBy(key)
    r = series.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(order)) - 1)
    return r.where(F.col("_r") % F.greatest(F.lit(1), F.floor(F.col("_n") / points)) == 0).drop("_n", "_r")


def confirmed(bars: DataFrame, horizon: Column, width: int) -> DataFrame:
    """Marks buckets that are over: their end, or the next bucket's start, is not beyond the horizon."""
    w = Window.partitionBy("symbol", "exchange").orderBy("timestamp")
    end = F.col("timestamp") + width
    return bars.withColumn("confirmed", (end <= horizon) | F.coalesce(F.lead("timestamp").over(w) >= end, F.lit(False)))
