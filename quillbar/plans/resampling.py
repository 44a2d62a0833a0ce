"""Queries of scans, catalogue, filters and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillbar.functions.intervals import parse_interval
from quillbar.operators import archive, resample
from quillbar.plans import Registry
from quillbar.sources.tables import table
from quillbar.sources.views import bars, daily, legs, long_series, ticks, with_views

R = Registry()
_FOLD = "arg_min(open, timestamp) as open, max(high) high, min(low) low, arg_max(close, timestamp) as close, cast(sum(volume) as bigint) as volume, arg_max(oi, timestamp) as oi"
_MID = "(timestamp + 19800) // 86400 * 86400 - 19800"
_DAY = "(timestamp + 19800) // 86400"


def _intraday(name: str, interval: str) -> None:
    n = parse_interval(interval).seconds
    sql = with_views("bars", f"""select symbol, exchange, cast({_MID} + 33300 + floor((timestamp - ({_MID} + 33300)) / {n}.0) * {n} as bigint) as timestamp, {_FOLD}
        from bars where interval = '1m' group by 1, 2, 3""")  # fmt: skip
    R.add(name, sql)(lambda s, d: resample.resample(bars(s, d), interval))


def _calendar(name: str, interval: str, label: str) -> None:
    sql = with_views("bars", f"select symbol, exchange, cast({label} as bigint) as timestamp, {_FOLD} from bars where interval = 'D' group by 1, 2, 3")
    R.add(name, sql)(lambda s, d: resample.resample(bars(s, d), interval))


_D = f"(date '1970-01-01' + cast({_DAY} as int))"
_MI = f"(year({_D}) * 12 + month({_D}) - 1)"
_intraday("r1_intraday_5m", "5m")
_intraday("r1_session_reset_7m", "7m")
_intraday("r1_intraday_2h", "2h")
_calendar("r2_three_day", "3D", f"floor({_DAY} / 3.0) * 3 * 86400")
_calendar("r3_weekly", "W", f"(floor(({_DAY} - 4) / 7.0) * 7 + 4) * 86400")
_calendar("r3_two_week", "2W", f"(floor(({_DAY} - 4) / 14.0) * 14 + 4) * 86400")
for _n, _t in ((1, "M"), (7, "7M"), (3, "Q"), (12, "Y")):
    _calendar(f"r{4 if _t.endswith('M') else 5}_{_t.lower()}_bars", _t, f"epoch(make_date(cast({_MI} // {_n} * {_n} // 12 as int), cast({_MI} // {_n} * {_n} % 12 + 1 as int), 1))")

R.add("r6_native", with_views("bars", "select symbol, exchange, timestamp, open, high, low, close, volume, oi from bars where interval = 'D'"))(
    lambda s, d: resample.resample(bars(s, d), "D")
)
R.add("r6_invalid_interval", with_views("bars", "select symbol, exchange, timestamp, open, high, low, close, volume, oi from bars where false"))(
    lambda s, d: resample.resample(bars(s, d), "5x")
)
R.add("r7_available", with_views("bars", """select distinct symbol, exchange, wanted from bars join (values ('5m', '1m'), ('2h', '1m'), ('W', 'D'), ('3M', 'D')) v(wanted, src) on interval = src"""))(
    lambda s, d: resample.available_intervals(bars(s, d), ["5m", "2h", "W", "3M", "zz"])
)
R.add("r8_label_convention", with_views("bars", f"select symbol, exchange, cast({_DAY} * 86400 as bigint) as label, count(*) as n from bars where interval = 'D' group by 1, 2, 3"))(
    lambda s, d: resample.resample(bars(s, d), "1D").groupBy("symbol", "exchange", (F.floor((F.col("timestamp") + 19800) / 86400) * 86400).alias("label")).agg(F.count("*").alias("n"))
)
R.add("r9_preopen_fold", with_views("bars", f"""select symbol, exchange, cast({_MID} + 33300 + floor((greatest(timestamp, {_MID} + 33300) - ({_MID} + 33300)) / 3600.0) * 3600 as bigint) as bucket, {_FOLD}
    from bars where interval = '1m' group by 1, 2, 3"""))(lambda s, d: resample.regrid_from_finer(bars(s, d).where("interval = '1m'"), 3600))  # fmt: skip
R.add("r10_open_stamped", with_views("bars", "select interval, cast(floor((timestamp - 1) / 300.0) * 300 as bigint) as stamp, count(*) n from bars group by 1, 2"))(
    lambda s, d: bars(s, d).groupBy("interval", resample.open_stamped(F.col("timestamp"), 300).alias("stamp")).agg(F.count("*").alias("n"))
)
R.add("r11_weekly_last_session", with_views("long", "select symbol, cast(date_trunc('week', day) as date) as period, max(day) as last_day, arg_max(close, day) as last_value from long group by 1, 2"))(
    lambda s, d: resample.last_of_period(long_series(s, d), F.to_date(F.date_trunc("week", "day")))
)
R.add("r12_month_end_last", with_views("long", "select symbol, cast(date_trunc('month', day) as date) as period, max(day) as last_day, arg_max(close, day) as last_value from long group by 1, 2"))(
    lambda s, d: resample.last_of_period(long_series(s, d), F.trunc("day", "month"))
)
for _rule, _p in (("monthly", "month"), ("quarterly", "quarter"), ("yearly", "year")):
    R.add(f"r13_rebalance_{_rule}", with_views("long", f"""select day from (select max(day) as day from long group by date_trunc('{_p}', day)) where day <> (select min(day) from long)"""))(
        lambda s, d, r=_rule: resample.rebalance_dates(long_series(s, d), r)
    )
R.add("r14_last_n_dates", with_views("ticks", """select symbol, day, n from (select symbol, day, n, dense_rank() over (partition by symbol order by day desc) r
    from (select symbol, cast(make_timestamp(us) as date) as day, count(*) n from ticks group by 1, 2)) where r <= 5"""))(
    lambda s, d: resample.last_dates(ticks(s, d).groupBy("symbol", F.to_date(F.timestamp_micros("us")).alias("day")).agg(F.count("*").alias("n")), 5)
)
R.add("r15_confirmed", with_views("bars", f""", w as (select symbol, exchange, cast((floor(({_DAY} - 4) / 7.0) * 7 + 4) * 86400 as bigint) as timestamp, arg_max(close, timestamp) as close
    from bars where interval = 'D' group by 1, 2, 3)
    select symbol, exchange, timestamp, close, timestamp + 604800 <= 1792000000 or coalesce(lead(timestamp) over (partition by symbol, exchange order by timestamp) >= timestamp + 604800, false) as confirmed from w"""))(
    lambda s, d: resample.confirmed(resample.resample(bars(s, d), "W").select("symbol", "exchange", "timestamp", "close"), F.lit(1792000000), 604800)
)
R.add("r16_thinned", with_views("long", """select symbol, day, close from (select *, row_number() over (partition by symbol order by day) - 1 r, count(*) over (partition by symbol) n from long)
    where r % greatest(1, n // 300) = 0"""))(lambda s, d: resample.thin(long_series(s, d), "symbol", "day"))  # fmt: skip
R.add("st1_tumbling_bars", with_views("ticks", """select symbol, cast(us // 300000000 * 300 as bigint) as bucket, arg_min(price, (us, event_id)) as open, max(price) high, min(price) low,
    arg_max(price, (us, event_id)) as close, cast(sum(size) as bigint) as volume, count(*) n from ticks group by 1, 2"""))(lambda s, d: resample.tick_bars(ticks(s, d), 300))  # fmt: skip

# ---- scans and catalogue
R.add("src1_window_scan", with_views("bars", "select symbol, timestamp, open, high, low, close, volume from bars where exchange = 'MCX' and interval = '1m' and symbol = 'ZINTARCONT' and timestamp >= 1793331000 and timestamp < 1793400000"))(
    lambda s, d: archive.read_window(bars(s, d), "zintarcont", "MCX", "1m", 1793331000, 1793400000, 200_000).select("symbol", "timestamp", "open", "high", "low", "close", "volume")
)
_REQ = [("w1", "ZINTARCONT", "MCX", "1m", 1792726200, 1792800000), ("w2", "zintarcont", "NCDEX", "5m", 1792726200, 1793300000), ("w3", "UNKNOWN", "NSE", "D", 0, 2000000000)]
R.add("src2_batched_windows", with_views("bars", """select request_id, cast(count(b.symbol) as bigint) as n, min(b.timestamp) as first_ts, max(b.timestamp) as last_ts
    from (values ('w1', 'ZINTARCONT', 'MCX', '1m', 1792726200, 1792800000), ('w2', 'ZINTARCONT', 'NCDEX', '5m', 1792726200, 1793300000), ('w3', 'UNKNOWN', 'NSE', 'D', 0, 2000000000))
    r(request_id, s, e, i, lo, hi) left join bars b on b.symbol = s and b.exchange = e and b.interval = i and b.timestamp >= lo and b.timestamp < hi group by 1"""))(
    lambda s, d: archive.read_many(bars(s, d), _REQ)
)
R.add("src3_pair_closes", with_views("daily", ", p as (select distinct symbol, exchange from daily where exchange = 'BSE') select symbol, exchange, day, close from daily semi join p using (symbol, exchange)"))(
    lambda s, d: archive.closes_for(daily(s, d), daily(s, d).where("exchange = 'BSE'").select("symbol", "exchange").distinct())
)
R.add("src13_inspect", with_views("bars", "select interval, count(*) n, min(timestamp) lo, max(timestamp) hi from bars group by 1"))(
    lambda s, d: bars(s, d).groupBy("interval").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
)
R.add("cat1_catalog", with_views("bars", "select symbol, exchange, interval, min(timestamp) first_ts, max(timestamp) last_ts, count(*) records from bars group by 1, 2, 3"))(lambda s, d: archive.catalog(bars(s, d)))
R.add("cat2_folded", with_views("bars", """select symbol, exchange, array_to_string(list_sort(list(distinct interval)), ',') as sources, min(timestamp) first_ts, max(timestamp) last_ts, count(*) as records
    from bars group by 1, 2"""))(lambda s, d: archive.fold_catalog(archive.catalog(bars(s, d))))  # fmt: skip
R.add("cat3_gap_plan", with_views("bars", """, c as (select symbol, exchange, interval, min(timestamp) lo, max(timestamp) hi from bars group by 1, 2, 3),
    q as (select *, 1750000000 as a, 1793000000 as z from c)
    select symbol, exchange, interval, 'earlier' as part, a as from_ts, lo as to_ts from q where a < lo
    union all select symbol, exchange, interval, 'later', case when interval = '1m' then (hi + 19800) // 86400 * 86400 - 19800 else hi end, z from q where z > hi"""))(
    lambda s, d: archive.gap_plan(archive.catalog(bars(s, d)), 1750000000, 1793000000)
)
R.add("snk1_upsert_view", with_views("bars", """select symbol, exchange, interval, timestamp, case when timestamp % 7 = 0 then close + 1 else close end as close, volume from bars"""))(
    lambda s, d: archive.upsert(bars(s, d), bars(s, d).where("timestamp % 7 = 0").withColumn("close", F.col("close") + 1)).select("symbol", "exchange", "interval", "timestamp", "close", "volume")
)
R.add("snk2_delete", with_views("bars", "select interval, count(*) n from bars where not (symbol = 'ZINTARCONT' and exchange = 'MCX') group by 1"))(
    lambda s, d: archive.delete(bars(s, d), s.createDataFrame([("ZINTARCONT", "MCX")], "symbol string, exchange string")).groupBy("interval").agg(F.count("*").alias("n"))
)
R.add("snk4_export_preview", with_views("bars", "select interval, count(*) as records, cast(count(*) * 72 as bigint) as bytes from bars group by 1"))(lambda s, d: archive.export_preview(bars(s, d)))
R.add("snk7_new_instruments", """select count(*) n from (select distinct l_partkey from lineitem) l where not exists (select 1 from part p where p.p_partkey = l.l_partkey and p_size < 25)""")(
    lambda s, d: table(s, d, "lineitem").select("l_partkey").distinct().join(table(s, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").agg(F.count("*").alias("n"))
)
R.add("snk9_retention", with_views("ticks", "select symbol, count(*) n from ticks where us >= epoch_us(timestamp '2024-01-20') or symbol = 'purchase' group by 1"))(
    lambda s, d: archive.retain(ticks(s, d), F.col("us") >= F.unix_micros(F.lit("2024-01-20").cast("timestamp")), F.col("symbol").isin("purchase")).groupBy("symbol").agg(F.count("*").alias("n"))
)
_NAME = r"regexp_extract(symbol, '^([A-Z]+?)(?:[0-9]{2}[A-Z]{3}[0-9]{2})', 1)"
R.add("snk10_bulk_update", f"select exchange, count(*) n, cast(count(*) filter (where name <> {_NAME} and {_NAME} <> '') as bigint) as rewritten from symtoken group by 1")(
    lambda s, d: archive.rewrite_names(table(s, d, "symtoken")).groupBy("exchange").agg(F.count("*").alias("n"), F.sum(F.col("changed").cast("int")).cast("bigint").alias("rewritten"))
)
R.add("snk13_sequence", "select p_brand, cast((select max(p_partkey) from part) + row_number() over (order by p_brand) as bigint) as id from (select distinct p_brand from part)")(
    lambda s, d: archive.next_ids(table(s, d, "part").select("p_brand").distinct(), table(s, d, "part").agg(F.max("p_partkey")), "p_brand")
)
R.add("snk14_content_id", with_views("bars", "select symbol, exchange, interval, sha256(concat_ws('|', symbol, exchange, interval, cast(min(timestamp) as varchar), cast(count(*) as varchar))) as id from bars group by 1, 2, 3"))(
    lambda s, d: archive.catalog(bars(s, d)).select("symbol", "exchange", "interval", F.sha2(F.concat_ws("|", "symbol", "exchange", "interval", F.col("first_ts").cast("string"), F.col("records").cast("string")), 256).alias("id"))
)
R.add("snk15_day_reset", with_views("ticks", "select symbol, cast(count(*) filter (where us < epoch_us(timestamp '2024-01-15')) as bigint) as reset, round(sum(case when us < epoch_us(timestamp '2024-01-15') then 0 else price end), 4) as today from ticks group by 1"))(
    lambda s, d: archive.reset_before(ticks(s, d), F.col("us") < F.unix_micros(F.lit("2024-01-15").cast("timestamp")), "price").groupBy("symbol").agg(F.sum(F.col("was_reset").cast("int")).cast("bigint").alias("reset"), F.round(F.sum("price"), 4).alias("today"))
)
R.add("snk16_missing_snapshots", "select o_custkey, cast(count(distinct o_orderdate) as bigint) as missing from orders where o_orderstatus = 'O' and not exists (select 1 from orders p where p.o_custkey = orders.o_custkey and p.o_orderdate = orders.o_orderdate and p.o_orderstatus = 'F') group by 1")(
    lambda s, d: archive.insert_missing(table(s, d, "orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderdate").distinct(), table(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate").distinct(), ["o_custkey", "o_orderdate"]).groupBy("o_custkey").agg(F.count("*").alias("missing"))
)

# ---- filters
R.add("f1_conjunct", with_views("bars", "select symbol, timestamp, close from bars where exchange = 'NSE' and interval = '15m' and timestamp between 1790000000 and 1792000000"))(
    lambda s, d: bars(s, d).where("exchange = 'NSE' and interval = '15m' and timestamp between 1790000000 and 1792000000").select("symbol", "timestamp", "close")
)
R.add("f4_multi_term_search", "select p_partkey, p_name, p_brand from part where (p_name ilike '%ring%' or p_brand ilike '%ring%' or p_type ilike '%ring%') and (p_name ilike '%12%' or p_brand ilike '%12%' or p_type ilike '%12%' or p_size = 12)")(
    lambda s, d: archive.search(table(s, d, "part"), "ring 12", ["p_name", "p_brand", "p_type"], "p_size").select("p_partkey", "p_name", "p_brand")
)
R.add("f5_empty_query", "select p_partkey from part where false")(lambda s, d: archive.search(table(s, d, "part"), "  ", ["p_name"], "p_size").select("p_partkey"))
R.add("f6_derivative_chain", "select distinct exchange, name, symbol, strike from symtoken where exchange = 'NFO' and symbol like '%CE' and strike between 50 and 200 and snapshot_date = date '2026-10-19'")(
    lambda s, d: archive.derivatives(table(s, d, "symtoken").where("snapshot_date = date '2026-10-19'"), exchange="NFO", suffix="CE", lo=50, hi=200).select("exchange", "name", "symbol", "strike").distinct()
)
R.add("f7_null_aware_lists", "select count(*) n from job_items where status not in ('success', 'skipped') or status is null")(
    lambda s, d: table(s, d, "job_items").where(~F.col("status").isin("success", "skipped") | F.col("status").isNull()).agg(F.count("*").alias("n"))
)
R.add("f8_prefix", "select count(*) n from symtoken where symbol like 'ZI%'")(lambda s, d: table(s, d, "symtoken").where(F.col("symbol").startswith("ZI")).agg(F.count("*").alias("n")))
R.add("f9_valid_bars", """select interval, count(*) n, cast(count(*) filter (where open > 0 and high > 0 and low > 0 and close > 0 and isfinite(open) and isfinite(high) and isfinite(low) and isfinite(close)
    and low <= least(open, close) and high >= greatest(open, close) and coalesce(volume, 0) >= 0) as bigint) as valid from market_data group by 1""")(
    lambda s, d: table(s, d, "market_data").groupBy("interval").agg(F.count("*").alias("n"), F.sum(archive.valid_bar().cast("int")).cast("bigint").alias("valid"))
)
R.add("f10_reject_split", """with m as (select symbol, exchange, interval, timestamp, open, high, low, close, volume, count(*) over (partition by symbol, exchange, interval, timestamp) c from market_data)
    select interval, case when not (open > 0 and high > 0 and low > 0 and close > 0 and isfinite(open) and isfinite(high) and isfinite(low) and isfinite(close)
      and low <= least(open, close) and high >= greatest(open, close) and coalesce(volume, 0) >= 0) then 'malformed' when c > 1 then 'duplicate' else 'accepted' end as verdict, count(*) n from m group by 1, 2""")(
    lambda s, d: archive.classify_rejects(table(s, d, "market_data")).groupBy("interval", "verdict").agg(F.count("*").alias("n"))
)
R.add("f11_tolerance_match", with_views("daily", """, p as (select a.symbol, a.day, a.close ca, b.close cb from daily a join daily b on a.symbol = b.symbol and a.day = b.day and a.exchange = 'NSE' and b.exchange = 'BSE')
    select symbol, count(*) n, cast(count(*) filter (where abs(ca - cb) <= greatest(2e-5 * greatest(abs(ca), abs(cb)), 0.02)) as bigint) matched from p group by 1"""))(
    lambda s, d: archive.tolerance_match(daily(s, d).where("exchange = 'NSE'"), daily(s, d).where("exchange = 'BSE'"))
)
R.add("f12_strict_threshold", with_views("long", "select symbol, cast(count(*) filter (where abs(close - 250000) > 1e-12 * greatest(abs(close), 250000) and close > 250000) as bigint) above from long group by 1"))(
    lambda s, d: long_series(s, d).groupBy("symbol").agg(F.sum(archive.strictly_above(F.col("close"), F.lit(250000.0)).cast("int")).cast("bigint").alias("above"))
)
R.add("f14_exchange_remap", "select case exchange when 'NFO' then 'NSE_FO' when 'CDS' then 'NSE_CD' when 'MCX' then 'MCX_FO' else exchange end as segment, count(*) n from symtoken group by 1")(
    lambda s, d: table(s, d, "symtoken").groupBy(archive.remap(F.col("exchange"), {"NFO": "NSE_FO", "CDS": "NSE_CD", "MCX": "MCX_FO"}).alias("segment")).agg(F.count("*").alias("n"))
)
R.add("f15_open_legs", with_views("legs", "select strategy, side, round(sum(case when side = 'SELL' then 1 else -1 end * qty), 4) as signed_qty from legs where qty <> 0 group by 1, 2"))(
    lambda s, d: legs(s, d).where("qty <> 0").groupBy("strategy", "side").agg(F.round(F.sum(F.when(F.col("side") == "SELL", 1).otherwise(-1) * F.col("qty")), 4).alias("signed_qty"))
)
R.add("f16_strike_modulus", "select strike, count(*) n from symtoken where strike > 0 and strike % 100 = 0 group by 1")(
    lambda s, d: table(s, d, "symtoken").where("strike > 0 and strike % 100 = 0").groupBy("strike").agg(F.count("*").alias("n"))
)
R.add("f17_tag_equality", "select strategy, count(*) n from sandbox_orders where strategy = 'orb' group by 1")(
    lambda s, d: archive.tagged(table(s, d, "sandbox_orders"), "strategy", "orb").groupBy("strategy").agg(F.count("*").alias("n"))
)
R.add("f18_tradeable_ticks", with_views("ticks", "select symbol, count(*) n from ticks where price > 0 and us is not null group by 1"))(
    lambda s, d: ticks(s, d).where("price > 0 and us is not null").groupBy("symbol").agg(F.count("*").alias("n"))
)
R.add("f19_condition_node", with_views("bars", "select interval, count(*) n from bars where close >= 500 and volume != 0 group by 1"))(
    lambda s, d: bars(s, d).where(archive.condition("close", ">=", 500.0) & archive.condition("volume", "!=", 0)).groupBy("interval").agg(F.count("*").alias("n"))
)
R.add("f20_position_check", "select user_id, round(sum(case action when 'BUY' then filled_quantity else -filled_quantity end), 0) > 100 as quantity_gt from sandbox_orders where order_status = 'complete' group by 1")(
    lambda s, d: table(s, d, "sandbox_orders").where("order_status = 'complete'").groupBy("user_id").agg((F.sum(F.when(F.col("action") == "BUY", F.col("filled_quantity")).otherwise(-F.col("filled_quantity"))) > 100).alias("quantity_gt"))
)
R.add("f21_time_window", with_views("bars", "select symbol, count(*) n from bars where interval = '1m' and (timestamp + 19800) % 86400 between 36000 and 39600 and ((timestamp + 19800) // 86400 + 3) % 7 < 5 group by 1"))(
    lambda s, d: bars(s, d).where(F.col("interval") == "1m").where(archive.time_window(F.col("timestamp"), "10:00", "11:00", [0, 1, 2, 3, 4])).groupBy("symbol").agg(F.count("*").alias("n"))
)
R.add("f22_gates", with_views("bars", "select interval, count(*) n from bars where (close > open and volume > 1000) or not (high > 100) group by 1"))(
    lambda s, d: bars(s, d).where(archive.gate_or(archive.gate_and(F.col("close") > F.col("open"), F.col("volume") > 1000), ~(F.col("high") > 100))).groupBy("interval").agg(F.count("*").alias("n"))
)
R.add("f23_stop_trigger", "select action, count(*) n from sandbox_orders where trigger_price is not null and case action when 'BUY' then average_price >= trigger_price else average_price <= trigger_price end group by 1")(
    lambda s, d: table(s, d, "sandbox_orders").where(F.col("trigger_price").isNotNull()).where(archive.stop_hit("action", "average_price", "trigger_price")).groupBy("action").agg(F.count("*").alias("n"))
)
R.add("f24_square_off", """select o.exchange, count(*) n from sandbox_orders o join (values ('NSE', 54900), ('BSE', 54900), ('NFO', 54900), ('BFO', 54900), ('CDS', 60300), ('BCD', 60300), ('MCX', 84600), ('NCDEX', 61200)) c(exchange, cut) on c.exchange = o.exchange
    where product = 'MIS' and filled_quantity <> 0 and (epoch(order_timestamp) + 19800) % 86400 >= cut group by 1""")(
    lambda s, d: archive.due_square_off(table(s, d, "sandbox_orders")).groupBy("exchange").agg(F.count("*").alias("n"))
)
R.add("f25_session_boundary", """select cast(floor((epoch(order_timestamp) + 19800 - 10800) / 86400.0) * 86400 + 10800 - 19800 as bigint) as boundary, count(*) n from sandbox_orders group by 1""")(
    lambda s, d: table(s, d, "sandbox_orders").groupBy(archive.session_boundary(F.unix_seconds("order_timestamp")).alias("boundary")).agg(F.count("*").alias("n"))
)
