"""Queries of files and feeds: what is written is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbar.operators import accounts, archive, resample
from quillbar.plans import Registry
from quillbar.session import shared_folder
from quillbar.sources import connectors
from quillbar.sources.tables import table
from quillbar.sources.views import bars, daily, long_series, ticks, with_views
from quillbar.streaming import bars as live

R = Registry()


def _new(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# ---- one series at any interval, from the stored minute bars
_MIDNIGHT = "(floor((timestamp + 19800) / 86400.0) * 86400 - 19800)"
_OHLCV = with_views("bars", f"""select cast({_MIDNIGHT} + 33300 + floor((timestamp - ({_MIDNIGHT} + 33300)) / 600.0) * 600 as bigint) as timestamp,
    arg_min(open, bars.timestamp) as open, max(high) as high, min(low) as low, arg_max(close, bars.timestamp) as close, cast(sum(volume) as bigint) as volume
  from bars where interval = '1m' and symbol = 'ZINTARCONT' and exchange = 'MCX' group by 1 having timestamp >= 1793331000 and timestamp < 1793400000""")
_OHLCV = _OHLCV.replace(" group by 1 having timestamp >= 1793331000 and timestamp < 1793400000", " group by 1").replace("select cast(", "select * from (select cast(", 1) + ") where timestamp >= 1793331000 and timestamp < 1793400000"


@R.add("src4_get_ohlcv", _OHLCV)
def src4_get_ohlcv(s: SparkSession, d: str) -> DataFrame:
    return resample.get_ohlcv(bars(s, d), "zintarcont", "MCX", "10m", 1793331000, 1793400000).select("timestamp", "open", "high", "low", "close", "volume")


# ---- a paged feed: pages side by side, stitched without doubles, open interest 0
_PAGES = """select t as timestamp, 100.0::double + t % 7 as open, 110.0::double + t % 7 as high, 90.0::double as low, 101.0::double + t % 5 as close, cast(t % 1000 as bigint) as volume, cast(0 as bigint) as oi
  from (select unnest(range(1790000040, 1790086400, 60)) as t)"""


@R.add("src5_history_source", _PAGES)
def src5_history_source(s: SparkSession, d: str) -> DataFrame:
    feed = {"from": "1790000000", "to": "1790086400", "page": "3610", "fetch": "quillbar.sources.connectors:sine_page"}
    return connectors.history(s, "api", **feed)


@R.add("src7_paged_history", "select timestamp // 3600 as hour, count(*) as n, cast(sum(volume) as bigint) as volume from (" + _PAGES + ") group by 1")
def src7_paged_history(s: SparkSession, d: str) -> DataFrame:
    got = src5_history_source(s, d)
    return got.groupBy(F.floor(F.col("timestamp") / 3600).alias("hour")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@R.add("src6_history_contract", with_views("bars", "select timestamp, open, high, low, close, volume, cast(0 as bigint) as oi from bars where interval = 'D' and exchange = 'NSE'"))
def src6_history_contract(s: SparkSession, d: str) -> DataFrame:
    return connectors.check_history(bars(s, d).where("interval = 'D' and exchange = 'NSE'").select("timestamp", "open", "high", "low", "close", "volume"))


# ---- CSV dumps, lists and uploads
_DUMP = "exchange string, token string, symbol string, lotsize int, strike double"


@R.add("src8_instrument_dump", "select exchange, trim(token) as token, symbol, lotsize, strike from symtoken where snapshot_date = (select min(snapshot_date) from symtoken) and exchange is not null and trim(token) <> '' and symbol is not null")
def src8_instrument_dump(s: SparkSession, d: str) -> DataFrame:
    path, t = _new(s), table(s, d, "symtoken")
    rows = t.where(F.col("snapshot_date") == t.agg(F.min("snapshot_date")).scalar()).where("exchange is not null and trim(token) <> '' and symbol is not null")
    rows.select("exchange", F.trim("token").alias("token"), "symbol", "lotsize", "strike").write.option("header", True).csv(path)
    return connectors.instrument_dump(s, path, _DUMP)


@R.add("src11_symbol_list", "select distinct upper(trim(symbol)) as symbol from symtoken where trim(symbol) <> '' and exchange = 'NSE'")
def src11_symbol_list(s: SparkSession, d: str) -> DataFrame:
    path = _new(s)
    table(s, d, "symtoken").where("exchange = 'NSE' and trim(symbol) <> ''").select(F.lower("symbol"), F.lit("x")).write.csv(path)
    return connectors.symbol_list(s, path).distinct()


def _import_sql(fmt_reason: bool) -> str:
    sane = "open > 0 and high > 0 and low > 0 and low <= least(open, close) and high >= greatest(open, close) and isfinite(high) and coalesce(volume, 0) >= 0"
    given = "open is not null and high is not null and low is not null and close is not null and timestamp is not null"
    state = f"case when not ({given}) then 'value' when not ({sane}) then 'prices' end"
    head = f"select case when {state} is null then 'accepted' else {state} end as verdict, " if fmt_reason else "select "
    return head + f"count(*) as n, cast(sum(coalesce(volume, 0)) as bigint) as volume from market_data where exchange = 'MCX' and interval = '5m' and not isnan(close) and not isnan(high) and not isnan(low) and not isnan(open)" + (" group by 1" if fmt_reason else "")


@R.add("src10_upload_import", _import_sql(True))
def src10_upload_import(s: SparkSession, d: str) -> DataFrame:
    """CSV upload of raw bars: accepted and rejected rows with their reason."""
    path = _new(s)
    raw = table(s, d, "market_data").where("exchange = 'MCX' and interval = '5m' and not isnan(close) and not isnan(high) and not isnan(low) and not isnan(open)")
    raw.select("timestamp", "open", "high", "low", "close", "volume", "oi").write.option("header", True).csv(path)
    good, bad = connectors.import_bars(s, path, "csv", "any", "MCX", "5m")
    both = good.withColumn("verdict", F.lit("accepted")).unionByName(bad.withColumnRenamed("reason", "verdict"))
    return both.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


# ---- sinks
_ALL = with_views("bars", "select symbol, exchange, interval, timestamp, open, high, low, close, volume, oi from bars where interval in ('5m', 'D')")
_COLS = ("symbol", "exchange", "interval", "timestamp", "open", "high", "low", "close", "volume", "oi")


@R.add("snk3_export", _ALL)
def snk3_export(s: SparkSession, d: str) -> DataFrame:
    """Compressed exports, one interval as text and one as Parquet, read back together."""
    text, binary = _new(s), _new(s)
    b = bars(s, d).select(*_COLS)
    archive.export(b.where("interval = '5m'"), text, "txt", "gzip")
    archive.export(b.where("interval = 'D'"), binary, "parquet", "zstd", ["exchange"])
    return s.read.csv(text, header=True, schema=b.schema).unionByName(s.read.parquet(binary).select(*_COLS))


@R.add("snk5_symbol_csv", with_views("bars", """select symbol as ticker, strftime(make_timestamp((timestamp + 19800) * 1000000), '%Y%m%d') as date, strftime(make_timestamp((timestamp + 19800) * 1000000), '%H:%M:%S') as time, close, volume
  from bars where interval = '15m' and exchange = 'NSE'"""))
def snk5_symbol_csv(s: SparkSession, d: str) -> DataFrame:
    path = _new(s)
    archive.export_symbol_csv(bars(s, d).where("interval = '15m' and exchange = 'NSE'"), path)
    got = s.read.csv(path, header=True, schema="DATE string, TIME string, OPEN double, HIGH double, LOW double, CLOSE double, VOLUME bigint, TICKER string")
    return got.select(F.col("TICKER").alias("ticker"), F.col("DATE").alias("date"), F.col("TIME").alias("time"), F.col("CLOSE").alias("close"), F.col("VOLUME").alias("volume"))


@R.add("snk6_append", with_views("daily", "select symbol, exchange, day, close from daily"))
def snk6_append(s: SparkSession, d: str) -> DataFrame:
    """A first load up to a day, then an append of everything, twice."""
    path, b = _new(s), daily(s, d).select("symbol", "exchange", "day", "close")
    b.where("day < date '2026-09-01'").write.parquet(path)
    for _ in range(2):
        archive.append_new(b, path, ["symbol", "exchange"], "day")
    return s.read.parquet(path)


@R.add("snk8_csv_text", "select concat_ws(',', cast(id as varchar), job_id, status, cast(records_downloaded as varchar)) as line from job_items where job_id is not null and status is not null and records_downloaded is not null and regexp_full_match(job_id, '[A-Za-z0-9_-]+')")
def snk8_csv_text(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "job_items").where("status is not null and records_downloaded is not null and job_id rlike '^[A-Za-z0-9_-]+$'")
    return archive.csv_text(i.select("id", "job_id", "status", "records_downloaded"))


# ---- records to columns and back
@R.add("reshape_p9_records_columns", with_views("long", "select symbol, day, close from long"))
def reshape_p9_records_columns(s: SparkSession, d: str) -> DataFrame:
    """Records of a series by month as columns (parallel arrays), and back to records."""
    month = long_series(s, d).groupBy("symbol", F.trunc("day", "month").alias("month")).agg(F.array_sort(F.collect_list(F.struct("day", "close"))).alias("r"))
    columns = month.select("symbol", F.col("r.day").alias("day"), F.col("r.close").alias("close"))
    return columns.select("symbol", F.inline(F.arrays_zip("day", "close")))


# ---- the closing timer: the last bucket of every symbol closes by the clock
_CLOSED = with_views("ticks", """, c as (select symbol, us // 3600000000 * 3600 as bucket, us, event_id, price, cast(sum(size) over (partition by symbol order by us, event_id rows unbounded preceding) as double) as cum from ticks),
  b as (select symbol, cast(bucket as bigint) as bucket, arg_min(price, (us, event_id)) as open, max(price) as high, min(price) as low, arg_max(price, (us, event_id)) as close, arg_max(cum, (us, event_id)) as last, count(*) as ticks from c group by 1, 2),
  p as (select *, lag(last) over w as before from b window w as (partition by symbol order by bucket))
  select symbol, bucket, open, high, low, close, last - before as volume, ticks from p where before is not null""")


@R.add("st5_closing_timer", _CLOSED)
def st5_closing_timer(s: SparkSession, d: str) -> DataFrame:
    t = ticks(s, d)
    cum = F.sum("size").over(Window.partitionBy("symbol").orderBy("us", "event_id"))
    order = F.row_number().over(Window.partitionBy("symbol").orderBy("us", "event_id"))
    feed = t.select("symbol", order.cast("bigint").alias("seq"), (F.col("us") / 1e6).alias("ts"), "price", cum.cast("double").alias("volume"))
    return live.closing_bars_batch(feed, 3600, clock=4102444800.0)


# ---- signals from one account of cash
def _signals(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list]:
    """Every close at a 10-session high is a signal of the account of its exchange; sessions are the days with bars (some hundred)."""
    b = daily(s, d)
    w = Window.partitionBy("symbol", "exchange").orderBy("day").rowsBetween(-10, -1)
    up = b.withColumn("top", F.max("close").over(w)).where("close > top")
    sig = up.select(F.col("exchange").alias("account"), F.xxhash64("symbol").alias("priority"), F.col("day").alias("signal_date"), F.concat_ws(":", "exchange", "symbol").alias("symbol"))
    days = [r.session_date for r in table(s, d, "trading_calendar").select("session_date").distinct().collect()]
    return sig, b.withColumn("symbol", F.concat_ws(":", "exchange", "symbol")), days


_RULES = accounts.Rules(capital=1_000_000.0, per_trade=50_000.0, trailing_pct=6.0, cost_bps=10.0, slippage_bps=5.0)


@R.add("sim6_account_ledger")
def sim6_account_ledger(s: SparkSession, d: str) -> DataFrame:
    return accounts.ledger(*_signals(s, d), _RULES)


@R.add("sim6_account_equity")
def sim6_account_equity(s: SparkSession, d: str) -> DataFrame:
    return accounts.equity_curve(*_signals(s, d), _RULES)
