"""Live ticks to bars.

``windowed_bars`` is the plain event-time aggregation: bars come out when the
watermark passes them. ``closing_bars`` keeps the feed's stricter rule with
state per symbol: a bar closes as soon as a tick of a later bucket arrives (or
the clock passes its end and the settling time), a tick of an earlier bucket is
dropped and never reopens one, the first bucket is dropped because its opening
was not watched, and a bar's volume is what the day's cumulative counter gained
since the bar before."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quillbar.operators.simulation import RISK, RiskState

BAR = "symbol string, bucket bigint, open double, high double, low double, close double, volume double, ticks bigint"


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """A stored table as a stream of its files."""
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    p = Path(sf_dir, f"{name}.parquet")
    return r.parquet(str(p)) if p.is_dir() else r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def clean_ticks(ticks: DataFrame) -> DataFrame:
    """Tradeable ticks (symbol, ts, price, volume): numbers that parse, a price above
    zero and a time in seconds or milliseconds, told apart by size."""
    num = lambda c: F.expr(f"try_cast({c} as double)")
    t = num("ts")
    secs = F.when(t < 100_000_000_000, t).otherwise(t / 1000)
    return ticks.select("symbol", F.timestamp_millis((secs * 1000).cast("bigint")).alias("at"), num("price").alias("price"), num("volume").alias("volume")).where("symbol is not null and at is not null and price > 0")


def windowed_bars(ticks: DataFrame, span: str, delay: str) -> DataFrame:
    """Bars from (symbol, at, price, size, seq) by event time."""
    o = F.struct("at", "seq")
    return (
        ticks.withWatermark("at", delay)
        .groupBy(F.window("at", span).alias("w"), "symbol")
        .agg(F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("n"))
        .select("symbol", F.unix_seconds("w.start").alias("bucket"), "open", "high", "low", "close", "volume", "n")
    )


class BarState:
    """The rule for one symbol; ticks are (second, price, cumulative volume)."""

    def __init__(self, span: int, settle: float = 0.2, state: tuple | None = None) -> None:
        self.span, self.settle = span, settle
        # bucket, open, high, low, close, last counter, counter at the bar before, ticks, watched from its opening
        self.s: list = list(state) if state else [None, 0.0, 0.0, 0.0, 0.0, None, None, 0, False]

    def _close(self) -> tuple | None:
        b, o, h, lo, c, last, before, n, whole = self.s
        vol = max(0.0, last - before) if last is not None and before is not None else 0.0
        self.s[6] = last if last is not None else before
        return (b, o, h, lo, c, vol, n) if whole else None

    def tick(self, t: float, p: float, cum: float | None) -> tuple | None:
        """Takes a tick; gives the bar that it closed, if it closed one."""
        b = int(t // self.span * self.span)
        s = self.s
        if s[0] is not None and b < s[0]:
            return None
        if b == s[0] and not s[7]:  # first tick after the clock closed the bucket before
            s[1], s[2], s[3], s[4], s[5], s[7] = p, p, p, p, cum, 1
            return None
        if b == s[0]:
            s[2], s[3], s[4], s[7] = max(s[2], p), min(s[3], p), p, s[7] + 1
            s[5] = cum if cum is not None else s[5]
            return None
        out = self._close() if s[0] is not None and s[7] else None
        first = s[0] is None
        s[0], s[1], s[2], s[3], s[4], s[5], s[7], s[8] = b, p, p, p, p, cum, 1, not first
        return out

    def clock(self, now: float) -> tuple | None:
        """Closes the bucket when its end and the settling time have passed."""
        if self.s[0] is not None and self.s[7] and now >= self.s[0] + self.span + self.settle:
            out = self._close()
            self.s[7] = 0
            self.s[0] += self.span  # later ticks of the closed bucket are late
            self.s[8] = True
            return out
        return None


class BarProcessor(StatefulProcessor):
    def __init__(self, span: int) -> None:
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bar", "b bigint, o double, h double, l double, c double, last double, before double, n bigint, whole boolean")

    def _rule(self) -> BarState:
        return BarState(self.span, state=tuple(self.state.get()) if self.state.exists() else None)

    def _emit(self, key: tuple, bars: list[tuple]) -> pd.DataFrame:
        cols = ["symbol", "bucket", "open", "high", "low", "close", "volume", "ticks"]
        return pd.DataFrame([(key[0], *b) for b in bars], columns=cols)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rule, bars = self._rule(), []
        for g in rows:
            g = g.sort_values(["ts", "seq"], kind="stable")
            for t, p, c in zip(g["ts"].tolist(), g["price"].tolist(), g["volume"].tolist()):
                if b := rule.tick(t, p, None if c != c else c):
                    bars.append(b)
        self.state.update(tuple(rule.s))
        if rule.s[7]:
            self.handle.registerTimer(int((rule.s[0] + self.span + rule.settle) * 1000))
        yield self._emit(key, bars)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rule = self._rule()
        b = rule.clock(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self.state.update(tuple(rule.s))
        yield self._emit(key, [b] if b else [])

    def close(self) -> None:
        pass


def closing_bars(ticks: DataFrame, span: int) -> DataFrame:
    """Bars from a stream of (symbol, ts seconds, seq, price, cumulative volume).
    The package has to be on the driver's Python path: the state runner starts its
    own interpreter. Timers run by the clock, so the query runs until stopped."""
    return ticks.groupBy("symbol").transformWithStateInPandas(statefulProcessor=BarProcessor(span), outputStructType=BAR, outputMode="Append", timeMode="ProcessingTime")


def closing_bars_batch(ticks: DataFrame, span: int, clock: float | None = None) -> DataFrame:
    """The same rule over stored ticks: streams each symbol in order of arrival.
    ``clock``: the time (seconds) it is after the last tick; a bucket whose end and
    settling time have passed by then closes without another tick."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, rule = None, BarState(span)
        ended = lambda: [(who, *x)] if who is not None and clock is not None and (x := rule.clock(clock)) else []
        for b in batches:
            out = []
            for k, t, p, c in zip(b["symbol"].tolist(), b["ts"].tolist(), b["price"].tolist(), b["volume"].tolist()):
                if k != who:
                    out += ended()
                    who, rule = k, BarState(span)
                if x := rule.tick(t, p, None if c != c else c):
                    out.append((k, *x))
            yield pd.DataFrame(out, columns=["symbol", "bucket", "open", "high", "low", "close", "volume", "ticks"])
        yield pd.DataFrame(ended(), columns=["symbol", "bucket", "open", "high", "low", "close", "volume", "ticks"])

    return ticks.select("symbol", "seq", "ts", "price", "volume").repartition("symbol").sortWithinPartitions("symbol", "seq").mapInPandas(run, BAR)


def warnings(ticks: DataFrame, jump: float = 0.2, silence: int = 30) -> DataFrame:
    """Ticks that jump by more than a share from the one before, or come after a longer silence. Every price after
    one of 0 jumps: the quotient is infinite or no number. Ticks without an instant come last."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy(F.asc_nulls_last("us"), F.asc_nulls_last("event_id"))
    p, t = F.lag("price").over(w), F.lag("us").over(w)
    jumped = F.when(p == 0, F.when(F.col("price").isNotNull(), True)).otherwise(F.abs(F.col("price") / p - 1) > jump)
    return ticks.select("symbol", "event_id", jumped.alias("jumped"), ((F.col("us") - t) > silence * 1_000_000).alias("stale")).where("jumped or stale")


def reconcile(history: DataFrame, live: DataFrame) -> DataFrame:
    """History and feed as one series: for a bar that both have, history counts."""
    u = history.withColumn("_o", F.lit(1)).unionByName(live.withColumn("_o", F.lit(0)))
    rest = [c for c in history.columns if c not in ("symbol", "bucket")]
    return u.groupBy("symbol", "bucket").agg(F.max_by(F.struct(*rest), "_o").alias("v")).select("symbol", "bucket", *[F.col(f"v.{c}").alias(c) for c in rest])


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there, into Parquet under ``folder``, and reads it back."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


class RiskProcessor(StatefulProcessor):
    """Watches positions tick by tick; the state is the best price and whether the position is out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("risk", "best double, out boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rule = RiskState(tuple(self.state.get()) if self.state.exists() else (None, False))
        out = []
        for g in rows:
            g = g.sort_values("seq", kind="stable")
            plain = g[["price", *RISK]].astype(object).where(g[["price", *RISK]].notna(), None)
            for seq, x in zip(g["seq"].tolist(), plain.itertuples(index=False, name=None)):
                level, why = rule.tick(*x)
                if why:
                    out.append((key[0], seq, level, why))
        self.state.update((rule.best, rule.out))
        yield pd.DataFrame(out, columns=["position", "seq", "stop_level", "exit"])

    def close(self) -> None:
        pass


def monitored_exits(ticks: DataFrame) -> DataFrame:
    """Exits from a stream of (position, seq, price and the columns ``RISK``)."""
    return ticks.groupBy("position").transformWithStateInPandas(
        statefulProcessor=RiskProcessor(), outputStructType="position string, seq bigint, stop_level double, exit string", outputMode="Append", timeMode="None"
    )
