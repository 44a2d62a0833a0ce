"""The candle archive: scans, writes, catalogue, filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbar.operators.ranking import ranked
from quillbar.session import cut_lineage
from quillbar.sources.tables import IST_OFFSET

PK = ["symbol", "exchange", "interval", "timestamp"]


# ---- scans
def read_window(bars: DataFrame, symbol: str, exchange: str, interval: str, lower: int, upper: int, limit: int) -> DataFrame:
    """Bars of one series in [lower, upper). A window with more rows than
    ``limit`` is an error, raised where the rows are read; the predicate is on
    stored columns, so it reaches the scan."""
    w = bars.where(
        (F.col("symbol") == symbol.upper()) & (F.col("exchange") == exchange) & (F.col("interval") == interval) & (F.col("timestamp") >= lower) & (F.col("timestamp") < upper)
    ).limit(limit + 1)  # one row more than allowed proves the excess
    n = F.count("*").over(Window.partitionBy("symbol", "exchange", "interval"))
    guard = F.when(F.col("_n") > limit, F.raise_error(F.lit(f"window holds more than {limit} rows")).cast("boolean")).otherwise(F.lit(True))
    return w.withColumn("_n", n).where(guard).drop("_n")


#: Windows one call may ask for; bounds what is broadcast.
MOST_REQUESTS = 16


def read_many(bars: DataFrame, requests: list[tuple[str, str, str, str, int, int]]) -> DataFrame:
    """Row count and range of many windows in one join; a window without rows has
    count 0. The requests are a literal list of the caller, at most ``MOST_REQUESTS``."""
    if len(requests) > MOST_REQUESTS:
        raise ValueError(f"at most {MOST_REQUESTS} windows at once")
    r = bars.sparkSession.createDataFrame(
        [(i, s.upper(), e, v, lo, hi) for i, s, e, v, lo, hi in requests], "request_id string, symbol string, exchange string, interval string, lo bigint, hi bigint"
    )
    b = bars.select(*PK)
    inside = (F.col("b.timestamp") >= F.col("r.lo")) & (F.col("b.timestamp") < F.col("r.hi"))
    on = [F.col(f"b.{c}") == F.col(f"r.{c}") for c in PK[:3]]
    hit = b.alias("b").join(F.broadcast(r).alias("r"), reduce(lambda x, y: x & y, on) & inside).groupBy("request_id").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )
    return r.select("request_id").join(hit, "request_id", "left").select("request_id", F.coalesce("n", F.lit(0)).alias("n"), "first_ts", "last_ts")


def closes_for(daily: DataFrame, pairs: DataFrame) -> DataFrame:
    """Daily closes of the listed (symbol, exchange) pairs."""
    return daily.join(pairs, ["symbol", "exchange"], "left_semi").select("symbol", "exchange", "day", "close")


# ---- writes; each returns the table's next state, so any table format can store it
def upsert(stored: DataFrame, rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Insert or replace on the primary key; the last write of a key wins. Applying
    the same rows twice changes nothing more."""
    key = key or PK
    both = stored.withColumn("_seq", F.lit(0)).unionByName(rows.withColumn("_seq", F.lit(1)))
    rest = [c for c in stored.columns if c not in key]
    v = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_seq", *rest)).alias("v"))
    return v.select(*key, *[F.col(f"v.{c}").alias(c) for c in rest])


def delete(stored: DataFrame, keys: DataFrame) -> DataFrame:
    return stored.join(keys, keys.columns, "left_anti")


def retain(rows: DataFrame, recent: Column, always: Column) -> DataFrame:
    """Retention: what is recent, and what is kept for ever."""
    return rows.where(F.coalesce(recent, F.lit(False)) | F.coalesce(always, F.lit(False)))


def rewrite_names(instruments: DataFrame) -> DataFrame:
    """Derives the underlying's name from a derivative symbol and rewrites only where it differs."""
    d = F.regexp_extract("symbol", r"^([A-Z]+?)(?:[0-9]{2}[A-Z]{3}[0-9]{2})", 1)
    changed = (d != "") & (F.col("name") != d)
    return instruments.withColumn("changed", F.coalesce(changed, F.lit(False))).withColumn("name", F.when(changed, d).otherwise(F.col("name")))


def next_ids(rows: DataFrame, high_water: DataFrame, order: str, bucket: Column | None = None) -> DataFrame:
    """Ids after the highest one in use, in the given order. ``bucket``: grows with
    the order and keeps a bounded number of rows together; by default the first
    letters of a text. Nulls come first."""
    if bucket is None:
        if rows.schema[order].dataType.simpleString() != "string":
            raise ValueError("an order that is no text needs a bucket")
        bucket = F.coalesce(F.substring(order, 1, 3), F.lit(""))
    pos = ranked(rows.withColumn("_all", F.lit(1)), ["_all"], [F.col(order)], bucket, "_pos")
    return pos.withColumn("id", (high_water.scalar() + F.col("_pos") + 1).cast("bigint")).drop("_all", "_pos")


def reset_before(rows: DataFrame, past: Column, amount: str) -> DataFrame:
    """Sets an amount to zero in rows of a past session."""
    return rows.withColumn("was_reset", past).withColumn(amount, F.when(past, F.lit(0.0)).otherwise(F.col(amount)))


def insert_missing(wanted: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append: those whose key is not stored yet."""
    return wanted.join(present, key, "left_anti")


def touch_alerts(open_alerts: DataFrame, raised: DataFrame) -> DataFrame:
    """One unresolved alert per kind: touched when it exists, else created."""
    o = open_alerts.select("alert_type", F.col("value").alias("_v"), F.col("first_seen"))
    r = raised.select("alert_type", "value", "at")
    return o.join(r, "alert_type", "full_outer").select(
        "alert_type", F.coalesce("value", "_v").alias("value"), F.coalesce("first_seen", "at").alias("first_seen"),
        F.when(F.col("first_seen").isNull(), "created").when(F.col("at").isNotNull(), "touched").otherwise("kept").alias("action"),
    )


def resolve_alerts(alerts: DataFrame, threshold: Column) -> DataFrame:
    """Marks alerts whose value fell below the threshold."""
    return alerts.withColumn("resolved", F.col("value") < threshold)


def write_archive(bars: DataFrame, path: str, partitions: int | None = None) -> None:
    """Stores bars partitioned by interval and exchange, sorted by symbol and
    time within files, so that row-group statistics prune."""
    b = bars.repartitionByRange(*([partitions] if partitions else []), "interval", "exchange", "symbol", "timestamp")
    b.sortWithinPartitions("interval", "exchange", "symbol", "timestamp").write.mode("overwrite").partitionBy("interval", "exchange").parquet(path)


def export(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None, split_by: list[str] | None = None) -> None:
    """CSV or Parquet export, optionally compressed and split by columns."""
    w = df.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    if split_by:
        w = w.partitionBy(*split_by)
    (w.option("header", True).csv if fmt in ("csv", "txt") else w.parquet)(path)


def export_symbol_csv(bars: DataFrame, path: str) -> None:
    """One folder of CSV per symbol, with the columns TICKER, DATE (yyyyMMdd) and
    TIME (HH:mm:ss, both in India), OPEN to VOLUME."""
    at = F.timestamp_seconds(F.col("timestamp") + IST_OFFSET)
    cols = [F.date_format(at, "yyyyMMdd").alias("DATE"), F.date_format(at, "HH:mm:ss").alias("TIME"), *[F.col(c).alias(c.upper()) for c in ("open", "high", "low", "close", "volume")]]
    bars.select(F.col("symbol").alias("TICKER"), *cols).repartition("TICKER").sortWithinPartitions("TICKER", "DATE", "TIME").write.mode("overwrite").partitionBy("TICKER").option("header", True).csv(path)


def csv_text(rows: DataFrame) -> DataFrame:
    """Every row as one line of CSV (column ``line``), in the order of the columns."""
    return rows.select(F.to_csv(F.struct(*rows.columns)).alias("line"))


def append_new(rows: DataFrame, path: str, key: list[str], at: str) -> DataFrame:
    """Appends to a stored table the rows that come after the last one stored of
    their key, and gives what was appended. The stored table is its own
    checkpoint, so an append that is repeated adds nothing."""
    spark = rows.sparkSession
    done = spark.read.parquet(path).groupBy(*key).agg(F.max(at).alias("_done"))
    fresh = rows.join(done, key, "left").where(F.col("_done").isNull() | (F.col(at) > F.col("_done"))).drop("_done")
    fresh = cut_lineage(fresh)  # what is read here must not see what is written below
    fresh.write.mode("append").parquet(path)
    return fresh


def export_preview(bars: DataFrame, row_bytes: int = 72) -> DataFrame:
    """Matching rows per interval and an estimate of their size."""
    return bars.groupBy("interval").agg(F.count("*").alias("records"), (F.count("*") * row_bytes).cast("bigint").alias("bytes"))


# ---- catalogue
def catalog(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "exchange", "interval").agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count("*").alias("records"))


def fold_catalog(cat: DataFrame) -> DataFrame:
    """One row per instrument over its stored intervals."""
    return cat.groupBy("symbol", "exchange").agg(
        F.array_join(F.sort_array(F.collect_set("interval")), ",").alias("sources"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("records").alias("records")
    )


def gap_plan(cat: DataFrame, start: int, end: int) -> DataFrame:
    """Ranges to fetch before and after what is stored; 1m series fetch their last day again."""
    day = F.floor((F.col("last_ts") + IST_OFFSET) / 86400) * 86400 - IST_OFFSET
    again = F.when(F.col("interval") == "1m", day).otherwise(F.col("last_ts")).cast("bigint")
    part = lambda name, a, z: F.struct(F.lit(name).alias("part"), a.cast("bigint").alias("from_ts"), z.cast("bigint").alias("to_ts"))
    parts = F.array_compact(
        F.array(
            F.when(F.lit(start) < F.col("first_ts"), part("earlier", F.lit(start), F.col("first_ts"))),
            F.when(F.lit(end) > F.col("last_ts"), part("later", again, F.lit(end))),
        )
    )
    return cat.select("symbol", "exchange", "interval", F.inline(parts))


# ---- predicates
def valid_bar() -> Column:
    """A bar that can be right: finite positive prices in order, volume not negative."""
    finite = [(F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(c) for c in ("open", "high", "low", "close")]
    order = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    return F.coalesce(reduce(lambda a, b: a & b, finite) & order & (F.coalesce("volume", F.lit(0)) >= 0), F.lit(False))


def classify_rejects(rows: DataFrame) -> DataFrame:
    """Verdict per row: malformed, duplicate (both copies of a key) or accepted."""
    n = F.count("*").over(Window.partitionBy(*PK))
    return rows.withColumn("_n", n).withColumn("verdict", F.when(~valid_bar(), "malformed").when(F.col("_n") > 1, "duplicate").otherwise("accepted")).drop("_n")


def is_close(a: Column, b: Column, rel: float, absolute: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def tolerance_match(left: DataFrame, right: DataFrame, rel: float = 2e-5, absolute: float = 0.02) -> DataFrame:
    """Compared and matching days per symbol of two sources."""
    j = left.select("symbol", "day", F.col("close").alias("a")).join(right.select("symbol", "day", F.col("close").alias("b")), ["symbol", "day"])
    ok = is_close(F.col("a"), F.col("b"), rel, absolute)
    return j.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(ok.cast("int")).cast("bigint").alias("matched"))


def strictly_above(v: Column, t: Column, eps: float = 1e-12) -> Column:
    """Above by more than a tie: values equal to within the tolerance are not above."""
    return ~is_close(v, t, eps, 0.0) & (v > t)


def search(df: DataFrame, query: str, columns: list[str], number: str) -> DataFrame:
    """Every term must be contained, whatever the case, in one of the columns; a
    numeric term also matches the number column. Pattern characters in a term
    are ordinary characters. An empty query finds nothing."""
    terms = query.split()
    if not terms:
        return df.where(F.lit(False))
    for t in terms:
        hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(t.lower())) for c in columns])
        if t.replace(".", "", 1).isdigit():
            hit = hit | (F.col(number) == float(t))
        df = df.where(hit)
    return df


def relevance(df: DataFrame, query: str, name: str, symbol: str) -> DataFrame:
    """Exact name first, then names and then symbols that begin with the query, then by symbol."""
    q = query.upper()
    rank = F.when(F.upper(name) == q, 0).when(F.upper(name).startswith(q), 1).when(F.upper(symbol).startswith(q), 2).otherwise(3)
    return df.withColumn("rank", rank).orderBy("rank", symbol)


def derivatives(df: DataFrame, exchange: str | None = None, name: str | None = None, suffix: str | None = None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Chain filter with optional parts."""
    if exchange:
        df = df.where(F.col("exchange") == exchange)
    if name:
        df = df.where(F.upper("name") == name.upper())
    if suffix:
        df = df.where(F.col("symbol").endswith(suffix))
    if lo is not None:
        df = df.where(F.col("strike") >= lo)
    return df.where(F.col("strike") <= hi) if hi is not None else df


def remap(c: Column, mapping: dict[str, str]) -> Column:
    """Value through a map, itself where the map has none."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c)


def tagged(df: DataFrame, tag: str, value: str | None) -> DataFrame:
    """Rows of one tag; without a tag there are none."""
    return df.where(F.col(tag) == value) if value else df.where(F.lit(False))


_OPS = {">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}


def condition(field: str, op: str, value: float) -> Column:
    """A comparison of a bar field."""
    if field not in ("ltp", "open", "high", "low", "close", "volume") or op not in _OPS:
        raise ValueError(f"unknown condition {field} {op}")
    return getattr(F.col(field), _OPS[op])(value)


def gate_and(*cs: Column) -> Column:
    """True when all are; an unknown part makes the whole unknown, also beside a false one."""
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cs])
    return F.when(known, reduce(lambda a, b: a & b, cs))


def gate_or(*cs: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cs])


def time_window(ts: Column, start: str, end: str, weekdays: list[int]) -> Column:
    """Clock time in India between two HH:MM (both included) on the given weekdays (Monday is 0)."""
    s, e = (int(x[:2]) * 3600 + int(x[3:]) * 60 for x in (start, end))
    clock = (ts + IST_OFFSET) % 86400
    return clock.between(s, e) & ((F.floor((ts + IST_OFFSET) / 86400) + 3) % 7).isin(weekdays)


def stop_hit(side: str, price: str, trigger: str) -> Column:
    """A buy stop fires at or above its trigger, a sell stop at or below."""
    return F.when(F.col(side) == "BUY", F.col(price) >= F.col(trigger)).otherwise(F.col(price) <= F.col(trigger))


#: Cut-off of intraday positions per exchange, seconds after midnight in India. Fixed values.
SQUARE_OFF = {"NSE": 54900, "BSE": 54900, "NFO": 54900, "BFO": 54900, "CDS": 60300, "BCD": 60300, "MCX": 84600, "NCDEX": 61200}


def due_square_off(orders: DataFrame) -> DataFrame:
    cut = F.try_element_at(F.create_map(*[F.lit(x) for kv in SQUARE_OFF.items() for x in kv]), F.col("exchange"))
    clock = (F.unix_seconds("order_timestamp") + IST_OFFSET) % 86400
    return orders.where((F.col("product") == "MIS") & (F.col("filled_quantity") != 0) & (clock >= cut))


def session_boundary(ts: Column, hour: int = 3) -> Column:
    """Start (UTC seconds) of the trading session, which begins at ``hour`` in India."""
    h = hour * 3600
    return (F.floor((ts + IST_OFFSET - h) / 86400) * 86400 + h - IST_OFFSET).cast("bigint")
