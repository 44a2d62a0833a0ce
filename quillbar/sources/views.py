"""Projections of the stored tables onto the shapes the operators take, and the
same projections as common table expressions for the DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbar.sources.tables import ist_day, latest_bars, table

SERIES = ["symbol", "exchange", "interval"]

VALID = (
    "open > 0 and high > 0 and low > 0 and close > 0 and open < 1e300 and high < 1e300 and low < 1e300 and close < 1e300 "
    "and low <= least(open, close) and high >= greatest(open, close) and coalesce(volume, 0) >= 0"
)


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Latest valid bars; null volume and open interest are 0."""
    b = latest_bars(table(spark, d, "market_data"), "open", "high", "low", "close", "volume", "oi").where(VALID)
    return b.withColumn("volume", F.coalesce("volume", F.lit(0))).withColumn("oi", F.coalesce("oi", F.lit(0)))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """One bar per (symbol, exchange, market day): the last reading of the day."""
    b = bars(spark, d).where("interval = 'D'").withColumn("day", ist_day("timestamp"))
    cols = ["open", "high", "low", "close", "volume", "oi"]
    return b.groupBy("symbol", "exchange", "day").agg(F.max_by(F.struct(*cols), "timestamp").alias("v")).select("symbol", "exchange", "day", *[f"v.{c}" for c in cols])


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """Events as ticks: symbol, event_id, us, price, size."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("size"), "user_id",
    )


def long_series(spark: SparkSession, d: str) -> DataFrame:
    """Order values as five long daily series: symbol, day, close."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / (F.lit(100.0) * F.count("*"))).alias("close")  # cents add up exactly in any order
    )


def chain(spark: SparkSession, d: str) -> DataFrame:
    """Option chain rows: expiry, strike, side, oi, volume, ltp (from parts and their line items)."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_brand")
    li = table(spark, d, "lineitem").select("l_partkey", "l_linestatus", "l_quantity", "l_discount", "l_linenumber")
    return (
        li.join(p, "l_partkey")
        .groupBy(F.substring("p_brand", 7, 1).alias("expiry"), (F.lit(100.0) + F.col("p_size")).alias("strike"), F.when(F.col("l_linestatus") == "O", "CE").otherwise("PE").alias("side"))
        .agg(
            F.sum(F.col("l_quantity").cast("double")).alias("oi"), F.count("*").cast("double").alias("volume"),
            (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / F.count("*").cast("double")).alias("ltp"),
        )
    )


def legs(spark: SparkSession, d: str) -> DataFrame:
    """Line items as trades: strategy, symbol, side, qty, price, fee, day."""
    return table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("strategy"), F.col("l_suppkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").cast("double").alias("qty"), (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("price"),
        (F.col("l_extendedprice").cast("double") * F.col("l_tax").cast("double")).alias("fee"), F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber",
    )


_VALID_TWIN = VALID.replace("open < 1e300 and high < 1e300 and low < 1e300 and close < 1e300", "isfinite(open) and isfinite(high) and isfinite(low) and isfinite(close)")

CTE = {
    "bars": f"""bars as (
  select symbol, exchange, interval, timestamp, open, high, low, close, coalesce(volume, 0) as volume, coalesce(oi, 0) as oi from (
    select *, row_number() over (partition by symbol, exchange, interval, timestamp order by created_at desc nulls last, open desc nulls last,
      high desc nulls last, low desc nulls last, close desc nulls last, volume desc nulls last, oi desc nulls last) rn
    from market_data where symbol is not null and exchange is not null and interval is not null and timestamp is not null) where rn = 1 and {_VALID_TWIN})""",
    "daily": """daily as (
  select symbol, exchange, date '1970-01-01' + cast(floor((timestamp + 19800) / 86400.0) as int) as day, arg_max(open, timestamp) open, arg_max(high, timestamp) high,
    arg_max(low, timestamp) low, arg_max(close, timestamp) as close, arg_max(volume, timestamp) volume, arg_max(oi, timestamp) oi
  from bars where interval = 'D' group by 1, 2, 3)""",
    "ticks": """ticks as (
  select event_type as symbol, event_id, epoch_us(ts) as us, value as price, cast(json_extract_string(props, '$.k') as int) as size, user_id from events)""",
    "long": """long as (
  select o_orderpriority as symbol, cast(o_orderdate as date) as day, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) / (100.0::double * count(*)) as close from orders group by 1, 2)""",
    "chain": """chain as (
  select substr(p_brand, 7, 1) as expiry, 100.0::double + p_size as strike, case when l_linestatus = 'O' then 'CE' else 'PE' end as side,
    sum(cast(l_quantity as double)) as oi, cast(count(*) as double) as volume, cast(sum(cast(round(l_discount * 100) as bigint)) as bigint) / cast(count(*) as double) as ltp
  from lineitem join part on l_partkey = p_partkey group by 1, 2, 3)""",
    "legs": """legs as (
  select l_linestatus as strategy, l_suppkey as symbol, case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side, cast(l_quantity as double) as qty,
    cast(l_extendedprice as double) / cast(l_quantity as double) as price, cast(l_extendedprice as double) * cast(l_tax as double) as fee,
    cast(l_shipdate as date) as day, l_orderkey, l_linenumber from lineitem)""",
}
_NEEDS = {"daily": ["bars", "daily"]}


def with_views(names: str, body: str) -> str:
    """The twin of a query: the named projections as common table expressions
    before ``body``, which may start with further ones (a comma first)."""
    order: list[str] = []
    for n in names.split():
        for k in _NEEDS.get(n, [n]):
            if k not in order:
                order.append(k)
    return "with " + ", ".join(CTE[k] for k in order) + "\n" + body


#: Twin of ``snapshots.latest_futures``: exchange, name, symbol, e (expiry as a date, of either form).
LATEST_FUTURES = """(select exchange, name, symbol, min((case when length(trim(expiry)) = 9 then try_strptime(trim(expiry), '%d-%b-%y') else
    coalesce(try_strptime(trim(expiry), '%d-%b-%Y'), try_strptime(trim(expiry), '%Y-%m-%d')) end)::date) as e
  from symtoken where instrumenttype = 'FUT' and trim(name) <> '' and trim(expiry) <> '' and snapshot_date = (select max(snapshot_date) from symtoken) group by 1, 2, 3)"""
