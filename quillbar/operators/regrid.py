"""Irregular readings onto a regular grid.

A series is read through cumulative counters. Its clock (seconds since the
session opened, or the number of sessions so far for daily bars) is one: a fall
or a new session is a reset, consecutive readings are differenced, and each
increment is distributed over the grid cells in proportion to its overlap. A
cell that lies wholly between the two readings of one increment is uncovered:
these cells are the missing periods. A bar's volume is an increment of its own
period and is distributed in the same way; of a real volume counter it would be
differenced first (``counter_increments``).

Scale: readings of a series are ordered within chunks of ``CHUNK_DAYS`` days, so
a hot series is spread over its chunks and no window holds more than a chunk;
sessions end with the day in India and never cross a chunk. Readings are folded
before the shuffle. The calendar is small and fixed; it is joined by equality,
and Spark broadcasts it only below its checked threshold.

Defined results: readings outside every session belong to no period; two
readings in a period count once as a reading and add up; null or negative volume
adds nothing; a session with a single reading has no hole; unknown intervals and
exchanges give no rows; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbar.sources.tables import IST_OFFSET, STEP_SECONDS, ist_day, latest_bars

SERIES = ["symbol", "exchange", "interval"]
#: Days of one chunk in which the readings of a series are ordered.
CHUNK_DAYS = 31


def counter_increments(readings: DataFrame, group: list[str], at: str, counter: str, run: str | None = None) -> DataFrame:
    """Adds ``increment`` and ``since``: what a cumulative counter gained since
    the reading before and when that was. A lower reading than before is a reset:
    the counter then started again from zero. The first reading's gain is its
    own value. Another value of ``run`` than before also is a reset, and nothing
    links the reading to the one before (``since`` is null)."""
    w = Window.partitionBy(*group).orderBy(at)
    linked = F.lit(True) if run is None else F.lag(run).over(w).eqNullSafe(F.col(run))
    before = F.when(linked, F.lag(counter).over(w))
    gain = F.when(before.isNull() | (F.col(counter) < before), F.col(counter)).otherwise(F.col(counter) - before)
    return readings.withColumn("increment", gain).withColumn("since", F.when(linked, F.lag(at).over(w)))


def spread_over_cells(rows: DataFrame, origin: Column, step: Column, start: str, end: str, amount: str) -> DataFrame:
    """Explodes rows onto the grid cells that [start, end) overlaps, the amount
    split in proportion; an empty span falls whole into the cell of its end.
    ``uncovered`` marks the cells that begin after the reading at ``start`` and
    end by the one at ``end``: no reading of the two lies in them."""
    lo = F.floor((F.col(start) - origin) / step)
    hi = F.greatest(lo, F.ceil((F.col(end) - origin) / step) - 1)
    r = rows.withColumn("cell", F.explode(F.sequence(lo, hi)))
    left, right = origin + F.col("cell") * step, origin + (F.col("cell") + 1) * step
    a = F.greatest(F.col(start), left)
    b = F.least(F.col(end), right)
    part = F.when(F.col(end) > F.col(start), (b - a) / (F.col(end) - F.col(start))).otherwise(F.lit(1.0))
    r = r.withColumn(amount, F.col(amount) * part)
    return r.withColumn("uncovered", (left > F.col(start)) & (right <= F.col(end)))


def _gained() -> Column:
    """The volume of a bar as an increment; null and negative ones are no reading of it."""
    return F.greatest(F.coalesce("volume", F.lit(0)), F.lit(0)).cast("double")


def _step() -> Column:
    c = F.lit(None).cast("bigint")
    for k, v in STEP_SECONDS.items():
        c = F.when(F.col("interval") == k, F.lit(v).cast("bigint")).otherwise(c)
    return c


def _sessions(calendar: DataFrame) -> DataFrame:
    """Sessions of an exchange with their number in order, of a calendar of some thousand rows."""
    one = calendar.groupBy("exchange", "session_date").agg(F.min("open_ts").alias("open_ts"), F.max("close_ts").alias("close_ts"))
    return one.withColumn("session_no", F.row_number().over(Window.partitionBy("exchange").orderBy("session_date")).cast("bigint"))


def _in_sessions(rows: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of intraday series within their session, and rows of daily series on a session's day."""
    dated = rows.withColumn("session_date", ist_day("timestamp")).withColumn("step", _step()).join(_sessions(calendar), ["exchange", "session_date"])
    return dated.where("step is not null and timestamp >= open_ts and timestamp < close_ts"), dated.where("interval = 'D'")


def _gaps(intraday: DataFrame, daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The uncovered cells of both: *SERIES, session_date, open_ts, step, slot; and *SERIES, slot (number of the session)."""
    chunk = F.floor((F.col("timestamp") + IST_OFFSET) / (86400 * CHUNK_DAYS))
    clock = intraday.withColumn("chunk", chunk).withColumn("clock", F.col("timestamp") - F.col("open_ts"))
    inc = counter_increments(clock, [*SERIES, "chunk"], "timestamp", "clock", run="session_date").where("since is not null")
    cells = spread_over_cells(inc, F.col("open_ts"), F.col("step"), "since", "timestamp", "increment").where("uncovered")
    days = counter_increments(daily.withColumn("slot", F.col("session_no")), SERIES, "slot", "session_no").where("since is not null")
    dcells = spread_over_cells(days.drop("slot").withColumn("at", F.col("since") + F.col("increment")), F.lit(0), F.lit(1), "since", "at", "increment").where("uncovered")
    return cells.select(*SERIES, "session_date", "open_ts", "step", F.col("cell").alias("slot")), dcells.select(*SERIES, F.col("cell").alias("slot"))


def _midnight(day: str) -> Column:
    return F.unix_date(day).cast("bigint") * 86400 - IST_OFFSET


def session_grid(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per period of every session in which a series has a reading, and
    for D per session of the exchange between the first and last reading.

    Columns: symbol, exchange, bar_interval, session_date, slot_ts, missing
    (uncovered, or before the first or after the last reading of the session),
    between (readings of the series before and after it, in the same session),
    volume (distributed), close (of the last reading in the period)."""
    r, d = _in_sessions(latest_bars(bars, "close", "volume"), calendar)
    holes, dholes = _gaps(r, d)
    one = [*SERIES, "session_date"]

    # periods within a session: a bar's volume falls on [timestamp, timestamp + step), up to the close
    r = r.withColumn("slot", F.floor((F.col("timestamp") - F.col("open_ts")) / F.col("step")))
    inc = r.withColumn("increment", _gained()).withColumn("until", F.least(F.col("timestamp") + F.col("step"), F.col("close_ts")))
    cells = spread_over_cells(inc, F.col("open_ts"), F.col("step"), "timestamp", "until", "increment").select(
        *one, F.col("cell").alias("slot"), F.when(F.col("cell") == F.col("slot"), F.struct("timestamp", "close")).alias("own"), F.col("increment").alias("v"), F.lit(False).alias("hole")
    )
    marked = cells.unionByName(holes.select(*one, "slot", F.lit(True).alias("hole")), allowMissingColumns=True)
    filled = marked.groupBy(*one, "slot").agg(F.max("hole").alias("hole"), F.sum("v").alias("volume"), F.max("own").alias("own"))
    bounds = r.groupBy(*one).agg(*[F.first(c).alias(c) for c in ("open_ts", "close_ts", "step")], F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    last = F.ceil((F.col("close_ts") - F.col("open_ts")) / F.col("step")) - 1
    grid = bounds.select(*one, "open_ts", "step", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("slot"))
    missing = F.coalesce("hole", F.lit(False)) | (F.col("slot") < F.col("lo")) | (F.col("slot") > F.col("hi"))
    intraday = grid.join(filled, [*one, "slot"], "left").select(
        *one, (F.col("open_ts") + F.col("slot") * F.col("step")).alias("slot_ts"), missing.alias("missing"),
        ((F.col("slot") > F.col("lo")) & (F.col("slot") < F.col("hi"))).alias("between"),
        F.when(~missing | (F.col("volume") > 0), F.round("volume", 6)).alias("volume"), F.col("own.close").alias("close"),
    )

    # sessions of the exchange, for daily bars
    numbered = _sessions(calendar).select("exchange", "session_date", F.col("session_no").alias("slot"))
    d = d.withColumn("slot", F.col("session_no"))
    dcell = d.groupBy(*SERIES, "slot").agg(F.sum(_gained()).alias("volume"), F.max(F.struct("timestamp", "close")).alias("own"))
    dall = dcell.withColumn("hole", F.lit(False)).unionByName(dholes.withColumn("hole", F.lit(True)), allowMissingColumns=True)
    span = Window.partitionBy(*SERIES)  # one row per session of a daily series
    daily = dall.withColumn("lo", F.min("slot").over(span)).withColumn("hi", F.max("slot").over(span)).join(numbered, ["exchange", "slot"]).select(
        *SERIES, "session_date", _midnight("session_date").alias("slot_ts"), F.col("hole").alias("missing"),
        ((F.col("slot") > F.col("lo")) & (F.col("slot") < F.col("hi"))).alias("between"), "volume", F.col("own.close").alias("close"),
    )
    return intraday.unionByName(daily).withColumnRenamed("interval", "bar_interval")


def missing_periods(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """symbol, exchange, bar_interval, slot_ts of every uncovered cell: the holes
    that the increments of the clock leave. Only the stamps are read."""
    readings = bars.select(*SERIES, "timestamp").where(" and ".join(f"`{c}` is not null" for c in [*SERIES, "timestamp"])).distinct()
    holes, dholes = _gaps(*_in_sessions(readings, calendar))
    numbered = _sessions(calendar).select("exchange", "session_date", F.col("session_no").alias("slot"))
    within = holes.select(*SERIES, (F.col("open_ts") + F.col("slot") * F.col("step")).alias("slot_ts"))
    daily = dholes.join(numbered, ["exchange", "slot"]).select(*SERIES, _midnight("session_date").alias("slot_ts"))
    return within.unionByName(daily).withColumnRenamed("interval", "bar_interval")
