"""Queries of aggregations, telemetry, books, sorts, sets, scalars and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbar.operators import align, archive, books, telemetry
from quillbar.operators.series import returns
from quillbar.operators.snapshots import expiry_date
from quillbar.plans import Registry
from quillbar.sources.tables import latest_bars, table
from quillbar.sources.views import bars, chain, daily, legs, long_series, ticks, with_views

R = Registry()
_RET = ", r as (select * from (select symbol, day, close, close / lag(close) over (partition by symbol order by day) - 1 as ret from long) where ret is not null)"


def _ret(s, d):
    return returns(long_series(s, d))


def _log(s, d):
    return ticks(s, d).select(F.concat(F.lit("b"), (F.col("user_id") % 5).cast("string")).alias("broker"), F.col("symbol").alias("tag"), F.col("price").alias("ms"), "us", "event_id", (F.col("symbol") == "error").alias("bad"))


_LOG = ", log as (select 'b' || (user_id % 5) as broker, symbol as tag, price as ms, us, event_id, symbol = 'error' as bad from ticks)"

R.add("a1_count_min_max", with_views("bars", "select interval, count(*) n, min(close) lo, max(close) hi from bars group by 1"))(
    lambda s, d: bars(s, d).groupBy("interval").agg(F.count("*").alias("n"), F.min("close").alias("lo"), F.max("close").alias("hi"))
)
R.add("a2_distinct_pairs", with_views("bars", "select cast(count(distinct (symbol, exchange)) as bigint) as n from bars"))(lambda s, d: bars(s, d).agg(F.count_distinct(F.struct("symbol", "exchange")).alias("n")))
R.add("a4_latency_rollup", with_views("ticks", _LOG + """ select coalesce(broker, 'all') as broker, coalesce(tag, 'all') as tag, cast(grouping(broker, tag) as int) as level, count(*) n, cast(count(*) filter (where bad) as bigint) failed,
    round(avg(ms), 4) avg_ms, min(ms) min_ms, max(ms) max_ms, round(1 - count(*) filter (where bad) / count(*), 6) as success_rate from log group by rollup (broker, tag)"""))(
    lambda s, d: telemetry.latency_rollup(_log(s, d), "broker", "tag", "ms", F.col("bad")).withColumn("avg_ms", F.round("avg_ms", 4)).withColumn("success_rate", F.round("success_rate", 6))
)
R.add("a3_conditional_counts", with_views("ticks", """select user_id, count(*) n, cast(count(*) filter (where symbol = 'error') as bigint) as errors, cast(count(*) filter (where price > 100) as bigint) as slow,
    round(sum(case when symbol = 'purchase' then price else 0 end), 4) as bought from ticks group by 1"""))(
    lambda s, d: ticks(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("symbol") == "error").alias("errors"), F.count_if(F.col("price") > 100).alias("slow"), F.round(F.sum(F.when(F.col("symbol") == "purchase", F.col("price")).otherwise(0.0)), 4).alias("bought"))
)
R.add("a5_group_counts", with_views("ticks", "select coalesce(case when symbol in ('click', 'view') then symbol when symbol is not null then 'other' end, 'all') as grp, count(*) n from ticks group by rollup (case when symbol in ('click', 'view') then symbol when symbol is not null then 'other' end)"))(
    lambda s, d: ticks(s, d).withColumn("grp", F.when(F.col("symbol").isin("click", "view"), F.col("symbol")).otherwise("other")).rollup("grp").agg(F.count("*").alias("n")).select(F.coalesce("grp", F.lit("all")).alias("grp"), "n")
)
R.add("a6_latency_percentiles", with_views("ticks", _LOG + """ select broker, tag, count(*) n, round(quantile_cont(ms, 0.5), 6) p50, round(quantile_cont(ms, 0.9), 6) p90, round(quantile_cont(ms, 0.95), 6) p95, round(quantile_cont(ms, 0.99), 6) p99
    from log group by 1, 2"""))(lambda s, d: telemetry.percentiles(_log(s, d), ["broker", "tag"], "ms").select("broker", "tag", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")]))  # fmt: skip
R.add("a7_avg_default", with_views("ticks", "select tag, round(coalesce(avg(case when bad then ms end), 0), 4) as avg_bad from (select symbol as tag, price as ms, symbol = 'error' as bad from ticks) group by 1"))(
    lambda s, d: _log(s, d).groupBy("tag").agg(F.round(F.coalesce(F.avg(F.when(F.col("bad"), F.col("ms"))), F.lit(0.0)), 4).alias("avg_bad"))
)
R.add("a8_threshold_buckets", with_views("ticks", _LOG + """ select broker, cast(count(*) filter (where ms < 10) as bigint) excellent, cast(count(*) filter (where ms >= 10 and ms < 50) as bigint) good,
    cast(count(*) filter (where ms >= 50 and ms < 150) as bigint) acceptable, cast(count(*) filter (where ms >= 150) as bigint) slow from log group by 1"""))(lambda s, d: telemetry.threshold_buckets(_log(s, d), ["broker"], "ms", (10, 50, 150)))  # fmt: skip
R.add("a9_health_summary", with_views("ticks", _LOG + """, h as (select *, case when ms < 50 then 'pass' when ms < 150 then 'warn' else 'fail' end st from log) select tag, arg_max(ms, (us, event_id)) as current, round(avg(ms), 4) average, min(ms) lowest, max(ms) highest,
    cast(count(*) filter (where st = 'pass') as bigint) passed, cast(count(*) filter (where st = 'warn') as bigint) warned, cast(count(*) filter (where st = 'fail') as bigint) failed from h group by 1"""))(
    lambda s, d: telemetry.health_summary(_log(s, d), ["tag"], "ms", F.struct("us", "event_id"), F.when(F.col("ms") < 50, "pass").when(F.col("ms") < 150, "warn").otherwise("fail")).withColumn("average", F.round("average", 4))
)
R.add("a10_ohlcv", with_views("bars", "select symbol, exchange, arg_min(open, timestamp) as open, max(high) high, min(low) low, arg_max(close, timestamp) as close, cast(sum(volume) as bigint) volume from bars where interval = '15m' group by 1, 2"))(
    lambda s, d: bars(s, d).where("interval = '15m'").groupBy("symbol", "exchange").agg(F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"))
)
R.add("a12_first_non_null", """select exchange, oi as first_oi from (select exchange, oi, row_number() over (partition by exchange order by oi is null, timestamp, symbol, interval) k from (
    select *, row_number() over (partition by symbol, exchange, interval, timestamp order by created_at desc nulls last, oi desc nulls last) rn from market_data
    where symbol is not null and exchange is not null and interval is not null and timestamp is not null) where rn = 1) where k = 1""")(
    lambda s, d: latest_bars(table(s, d, "market_data"), "oi").groupBy("exchange").agg(F.min_by("oi", F.when(F.col("oi").isNotNull(), F.struct("timestamp", "symbol", "interval"))).alias("first_oi"))
)
R.add("a13_best_worst_day", with_views("long", _RET + " select symbol, arg_max(day, (ret, -epoch(day))) as best, arg_min(day, (ret, day)) as worst from r group by 1"))(
    lambda s, d: _ret(s, d).groupBy("symbol").agg(F.max_by("day", F.struct(F.col("ret"), -F.unix_date("day"))).alias("best"), F.min_by("day", F.struct("ret", "day")).alias("worst"))
)
R.add("a14_compound", with_views("long", _RET + " select symbol, round(exp(sum(ln(1 + ret))) - 1, 6) as total from r group by 1"))(lambda s, d: _ret(s, d).groupBy("symbol").agg(F.round(F.exp(F.sum(F.log1p("ret"))) - 1, 6).alias("total")))
R.add("a15_hhi", with_views("legs", ", w as (select symbol, sum(qty) / (select sum(qty) from legs) as w from legs group by 1) select round(sum(w * w), 8) as hhi, round(1 / sum(w * w), 4) as effective, round(max(w), 8) as largest, count(*) n from w"))(
    lambda s, d: legs(s, d).groupBy("symbol").agg((F.sum("qty") / legs(s, d).agg(F.sum("qty")).scalar()).alias("w")).agg(F.round(F.sum(F.col("w") * F.col("w")), 8).alias("hhi"), F.round(1 / F.sum(F.col("w") * F.col("w")), 4).alias("effective"), F.round(F.max("w"), 8).alias("largest"), F.count("*").alias("n"))
)
R.add("a17_mean_pair_correlation", with_views("long", _RET + ", p as (select corr(a.ret, b.ret) as c from r a join r b on a.day = b.day and a.symbol < b.symbol group by a.symbol, b.symbol) select round(avg(c), 6) as mean_corr from p"))(
    lambda s, d: align.pair_correlations(_ret(s, d)).agg(F.round(F.avg("corr"), 6).alias("mean_corr"))
)
R.add("a18_diversification", with_views("long", _RET + """, c as (select a.symbol a, b.symbol b, covar_samp(a.ret, b.ret) * 252 as c from r a join r b on a.day = b.day group by 1, 2)
    select round(sqrt(sum(c) / 25.0), 6) as portfolio_vol, round(sum(case when a = b then sqrt(c) / 5.0 end) / sqrt(sum(c) / 25.0), 6) as ratio from c"""))(
    lambda s, d: _ret(s, d).select(F.col("symbol").alias("a"), "day", F.col("ret").alias("x")).join(_ret(s, d).select(F.col("symbol").alias("b"), "day", F.col("ret").alias("y")), "day").groupBy("a", "b").agg((F.covar_samp("x", "y") * 252).alias("c"))
    .agg(F.round(F.sqrt(F.sum("c") / 25.0), 6).alias("portfolio_vol"), F.round(F.sum(F.when(F.col("a") == F.col("b"), F.sqrt("c") / 5.0)) / F.sqrt(F.sum("c") / 25.0), 6).alias("ratio"))
)
R.add("a19_capture", with_views("long", _RET + """, b as (select day, avg(ret) m from r group by 1) select symbol, round(avg(case when m > 0 then ret end) / avg(case when m > 0 then m end), 6) as up, round(avg(case when m < 0 then ret end) / avg(case when m < 0 then m end), 6) as down
    from r join b on r.day = b.day group by 1"""))(
    lambda s, d: _ret(s, d).join(_ret(s, d).groupBy("day").agg(F.avg("ret").alias("m")), "day").groupBy("symbol").agg(
        F.round(F.avg(F.when(F.col("m") > 0, F.col("ret"))) / F.avg(F.when(F.col("m") > 0, F.col("m"))), 6).alias("up"), F.round(F.avg(F.when(F.col("m") < 0, F.col("ret"))) / F.avg(F.when(F.col("m") < 0, F.col("m"))), 6).alias("down"))
)
R.add("a20_deviations", with_views("long", _RET + " select symbol, round(stddev_samp(ret), 8) as samp, round(stddev_pop(ret), 8) as pop from r group by 1"))(
    lambda s, d: _ret(s, d).groupBy("symbol").agg(F.round(F.stddev_samp("ret"), 8).alias("samp"), F.round(F.stddev_pop("ret"), 8).alias("pop"))
)
R.add("a21_spread_stats", with_views("long", _RET + " select symbol, round(median(ret), 6) as mid, round(avg((ret > 0)::int), 6) as positive, round(max(ret), 6) best, round(min(ret), 6) worst from r group by 1"))(
    lambda s, d: _ret(s, d).groupBy("symbol").agg(F.round(F.median("ret"), 6).alias("mid"), F.round(F.avg((F.col("ret") > 0).cast("int")), 6).alias("positive"), F.round(F.max("ret"), 6).alias("best"), F.round(F.min("ret"), 6).alias("worst"))
)
_COH = """, d as (select strategy, side, day, count(*) n, sum(pnl) s, sum((pnl > 0)::int) w from (select *, (price - 30000) / 1000 as pnl from legs) group by 1, 2, 3),
 k as (select *, s / n as m, row_number() over (partition by strategy, side order by day) r, count(*) over (partition by strategy, side) c from d)
 select strategy, side, cast(sum(n) as bigint) n, count(*) as days, round(sum(s) / sum(n), 4) mean, round(sum(w) / sum(n), 6) win_rate, round(sum(s), 2) total, round(avg(m), 4) mean_of_days,
 avg(case when r <= c // 2 then m end) > 0 and avg(case when r > c // 2 then m end) > 0 as both_halves_up, sum(n) >= 30 and count(*) >= 20 as sufficient from k group by 1, 2"""
R.add("a22_cohorts", with_views("legs", _COH))(
    lambda s, d: books.cohort_stats(legs(s, d).withColumn("pnl", (F.col("price") - 30000) / 1000), ["strategy", "side"], "pnl", "day").select(
        "strategy", "side", "n", "days", F.round("mean", 4).alias("mean"), F.round("win_rate", 6).alias("win_rate"), F.round("total", 2).alias("total"), F.round("mean_of_days", 4).alias("mean_of_days"), "both_halves_up", "sufficient")
)
R.add("a24_class_weights", "select instrumenttype, round(sum(lotsize) / (select sum(lotsize) from symtoken), 8) as weight from symtoken group by 1")(
    lambda s, d: books.weight_sums(table(s, d, "symtoken").withColumn("w", F.col("lotsize") / table(s, d, "symtoken").agg(F.sum("lotsize")).scalar()), "instrumenttype", "w").withColumn("weight", F.round("weight", 8))
)
R.add("a25_daily_activity", with_views("legs", """select day, round(sum(case when side = 'BUY' then qty * price else 0 end), 2) as bought, round(sum(case when side = 'SELL' then qty * price else 0 end), 2) as sold, count(*) fills, round(sum(fee), 5) fees,
    round(sum(qty * price), 2) as turnover, round(sum(qty * price) / 1e9, 12) as turnover_share from legs group by 1"""))(
    lambda s, d: books.daily_activity(legs(s, d), 1e9).select("day", *[F.round(c, 2).alias(c) for c in ("bought", "sold", "turnover")], F.round("fees", 5).alias("fees"), "fills", F.round("turnover_share", 12).alias("turnover_share"))
)
R.add("j9_mtm_books", with_views("legs", """, p as (select strategy, symbol, sum(qty) as qty, sum(qty * price) / sum(qty) as price from legs group by 1, 2), l as (select s_suppkey as symbol, s_acctbal as ltp from supplier where s_suppkey % 3 <> 0)
    select strategy, count(*) legs, cast(count(*) filter (where ltp is null) as bigint) unpriced, round(sum(qty), 2) as open_qty, round(sum(case when ltp is not null then (ltp - price) * qty else 0 end), 2) as unrealized from p left join l using (symbol) group by 1"""))(
    lambda s, d: books.mark_to_market(
        legs(s, d).groupBy("strategy", "symbol").agg(F.sum("qty").alias("qty"), (F.sum(F.col("qty") * F.col("price")) / F.sum("qty")).alias("price")),
        table(s, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("ltp")), ["symbol"]).select("strategy", "legs", "unpriced", F.round("open_qty", 2).alias("open_qty"), F.round("unrealized", 2).alias("unrealized"))
)
R.add("a26_strategy_books", with_views("legs", "select strategy, round(sum(case when side = 'SELL' then qty * price else -qty * price end), 2) as realized, round(sum(qty), 2) as open_qty, cast(count(distinct symbol) as bigint) as legs from legs group by 1"))(
    lambda s, d: legs(s, d).groupBy("strategy").agg(F.round(F.sum(F.when(F.col("side") == "SELL", F.col("qty") * F.col("price")).otherwise(-F.col("qty") * F.col("price"))), 2).alias("realized"), F.round(F.sum("qty"), 2).alias("open_qty"), F.count_distinct("symbol").alias("legs"))
)
R.add("a28_holdings", with_views("legs", """, p as (select symbol, sum(qty) qty, sum(qty * price) / sum(qty) as price, max(price) as ltp from legs group by 1)
    select symbol, round(qty * ltp - qty * price, 2) as pnl, round((qty * ltp / (qty * price) - 1) * 100, 6) as pnl_pct, round(qty * ltp / (select sum(qty * ltp) from p), 8) as weight from p"""))(
    lambda s, d: books.holdings(legs(s, d).groupBy("symbol").agg(F.sum("qty").alias("qty"), (F.sum(F.col("qty") * F.col("price")) / F.sum("qty")).alias("price"), F.max("price").alias("ltp")))
    .select("symbol", F.round("pnl", 2).alias("pnl"), F.round("pnl_pct", 6).alias("pnl_pct"), F.round("weight", 8).alias("weight"))
)
R.add("a29_order_status", """select exchange, count(*) total, cast(count(*) filter (where order_status = 'open') as bigint) as open, cast(count(*) filter (where order_status = 'complete') as bigint) completed,
    cast(count(*) filter (where order_status = 'rejected') as bigint) rejected, cast(count(*) filter (where order_status = 'cancelled') as bigint) cancelled from sandbox_orders group by 1""")(lambda s, d: books.status_counts(table(s, d, "sandbox_orders"), "order_status", ["exchange"]))  # fmt: skip
R.add("a30_year_buckets", with_views("long", "select symbol, cast(year(day) as int) as year, round(arg_max(close, day) / arg_min(close, day) - 1, 6) as change from long group by 1, 2"))(
    lambda s, d: long_series(s, d).groupBy("symbol", F.year("day").alias("year")).agg(F.round(F.max_by("close", "day") / F.min_by("close", "day") - 1, 6).alias("change"))
)
_MON = ", m as (select symbol, cast(date_trunc('month', day) as date) mo, arg_max(close, day) c from long group by 1, 2), q as (select symbol, mo, c / lag(c) over (partition by symbol order by mo) - 1 as ret from m)"
R.add("a31_seasonality", with_views("long", _MON + " select symbol, cast(month(mo) as int) as month, round(avg(ret), 6) mean, round(stddev_samp(ret), 6) sd, round(avg((ret >= 0)::int), 6) as up from q where ret is not null group by 1, 2"))(
    lambda s, d: _monthly(s, d).groupBy("symbol", F.month("mo").alias("month")).agg(F.round(F.avg("ret"), 6).alias("mean"), F.round(F.stddev_samp("ret"), 6).alias("sd"), F.round(F.avg((F.col("ret") >= 0).cast("int")), 6).alias("up"))
)


def _monthly(s, d):
    m = long_series(s, d).groupBy("symbol", F.trunc("day", "month").alias("mo")).agg(F.max_by("close", "day").alias("c"))
    return m.withColumn("ret", F.col("c") / F.lag("c").over(Window.partitionBy("symbol").orderBy("mo")) - 1).where("ret is not null")


R.add("a32_coverage", with_views("daily", """, s as (select symbol, exchange, min(day) lo, max(day) hi, count(*) k from daily group by 1, 2)
    select s.symbol, s.exchange, cast(count(*) as bigint) as sessions, cast(count(*) filter (where c.session_date < lo) as bigint) as head, cast(count(*) filter (where c.session_date > hi) as bigint) as tail,
    cast(count(*) filter (where c.session_date between lo and hi and d.day is null) as bigint) as internal from s join trading_calendar c on c.exchange = s.exchange left join daily d on d.symbol = s.symbol and d.exchange = s.exchange and d.day = c.session_date group by 1, 2"""))(
    lambda s, d: daily(s, d).groupBy("symbol", "exchange").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).join(table(s, d, "trading_calendar").select("exchange", F.col("session_date").alias("day")), "exchange")
    .join(daily(s, d).select("symbol", "exchange", "day", F.lit(1).alias("has")), ["symbol", "exchange", "day"], "left").groupBy("symbol", "exchange").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("day") < F.col("lo")).alias("head"), F.count_if(F.col("day") > F.col("hi")).alias("tail"), F.count_if(F.col("day").between(F.col("lo"), F.col("hi")) & F.col("has").isNull()).alias("internal"))
)
R.add("a33_sets", with_views("bars", "select symbol, array_to_string(list_sort(list(distinct exchange)), ',') as exchanges from bars group by 1"))(lambda s, d: bars(s, d).groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_set("exchange")), ",").alias("exchanges")))
R.add("a34_weighted_cost", with_views("legs", "select symbol, round(sum(qty * price) / sum(qty), 4) as cost from legs group by 1"))(lambda s, d: legs(s, d).groupBy("symbol").agg(F.round(F.sum(F.col("qty") * F.col("price")) / F.sum("qty"), 4).alias("cost")))
R.add("a35_trade_quality", with_views("legs", ", t as (select *, price - 1500 - qty * 20 as pnl from legs) select strategy, side, count(*) n, round(sum(case when pnl > 0 then pnl else 0 end) / nullif(sum(case when pnl < 0 then -pnl else 0 end), 0), 6) as profit_factor, round(avg((pnl > 0)::int), 6) as win_rate, count(*) >= 30 as adequate from t group by 1, 2"))(
    lambda s, d: books.trade_quality(legs(s, d).withColumn("pnl", F.col("price") - 1500 - F.col("qty") * 20), ["strategy", "side"]).withColumn("profit_factor", F.round("profit_factor", 6)).withColumn("win_rate", F.round("win_rate", 6))
)
R.add("a37_pnl_range", with_views("legs", ", p as (select strategy, day, sum(sum(case when side = 'SELL' then qty * price else -qty * price end)) over (partition by strategy order by day) as cum from legs group by 1, 2) select strategy, round(min(cum), 1) as lowest, round(max(cum), 1) as highest from p group by 1"))(
    lambda s, d: legs(s, d).groupBy("strategy", "day").agg(F.sum(F.when(F.col("side") == "SELL", 1).otherwise(-1) * F.col("qty") * F.col("price")).alias("p")).withColumn("cum", F.sum("p").over(Window.partitionBy("strategy").orderBy("day")))
    .groupBy("strategy").agg(F.round(F.min("cum"), 1).alias("lowest"), F.round(F.max("cum"), 1).alias("highest"))
)
R.add("pf1_cost_schedule", with_views("legs", """, o as (select l_orderkey as order_id, sum(case when side = 'BUY' then qty * price else 0 end) as buy, sum(case when side = 'SELL' then qty * price else 0 end) as sell from legs group by 1),
    c as (select order_id, buy, sell, least(20.0, (buy + sell) * 0.0003) as brokerage, sell * 0.001 as levy, (buy + sell) * 0.0000345 as exchange_fee, buy * 0.00015 as stamp from o)
    select order_id, round(brokerage + levy + exchange_fee + stamp + (brokerage + exchange_fee) * 0.18 + (buy + sell) * 0.0005, 4) as total_cost from c"""))(
    lambda s, d: books.costs(
        legs(s, d).groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sum(F.when(F.col("side") == "BUY", F.col("qty") * F.col("price")).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("side") == "SELL", F.col("qty") * F.col("price")).otherwise(0.0)).alias("sell")),
        [("brokerage", "order", 0.0003, 20.0, True), ("levy", "sell", 0.001, None, False), ("exchange_fee", "turnover", 0.0000345, None, True), ("stamp", "buy", 0.00015, None, False)], slippage=0.0005,
    ).select("order_id", F.round("total_cost", 4).alias("total_cost"))
)
R.add("st13_fill_booking")(
    lambda s, d: books.book_fills(legs(s, d).select("symbol", "l_orderkey", "l_linenumber", (F.when(F.col("side") == "SELL", -1.0).otherwise(1.0) * F.col("qty")).alias("qty"), "price"), ["symbol"], ["l_orderkey", "l_linenumber"])
)
R.add("s9_open_legs_first", "select user_id, array_to_string(list(symbol order by (coalesce(filled_quantity, 0) = 0), id), ',') as symbols from sandbox_orders where symbol is not null group by 1")(
    lambda s, d: books.legs_open_first(table(s, d, "sandbox_orders").where("symbol is not null").select(F.col("user_id").alias("strategy"), F.coalesce("filled_quantity", F.lit(0)).alias("qty"), F.col("id").alias("seq"), "symbol"))
    .select(F.col("strategy").alias("user_id"), F.array_join("symbols", ",").alias("symbols"))
)

# ---- sorts, limits (each a report of the first rows)
R.add("s1_order_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")(lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice"))
R.add("s2_relevance", "select p_partkey, case when upper(p_name) = 'RED' then 0 when upper(p_name) like 'RED%' then 1 when upper(p_brand) like 'RED%' then 2 else 3 end as rank from part")(
    lambda s, d: archive.relevance(table(s, d, "part"), "red", "p_name", "p_brand").select("p_partkey", "rank")
)
R.add("s3_expiry_order", "select expiry, dense_rank() over (order by coalesce(case when length(expiry) = 9 then try_strptime(expiry, '%d-%b-%y') else try_strptime(expiry, '%d-%b-%Y') end::date, date '9999-12-31')) as pos from (select distinct expiry from symtoken)")(
    lambda s, d: table(s, d, "symtoken").select("expiry").distinct().withColumn("pos", F.dense_rank().over(Window.orderBy(F.coalesce(expiry_date("expiry"), F.lit("9999-12-31").cast("date")))))
)
R.add("s4_custom_order", "select status, row_number() over (order by case status when 'success' then 0 when 'failed' then 1 when 'skipped' then 2 else 9 end, status nulls last) as pos from (select distinct status from job_items)")(
    lambda s, d: table(s, d, "job_items").select("status").distinct().withColumn("pos", F.row_number().over(Window.orderBy(F.when(F.col("status") == "success", 0).when(F.col("status") == "failed", 1).when(F.col("status") == "skipped", 2).otherwise(9), F.asc_nulls_last("status"))))
)
R.add("s5_top_bottom", with_views("daily", ", m as (select symbol, exchange, arg_max(close, day) / arg_min(close, day) - 1 as move from daily group by 1, 2), t as (select *, row_number() over (order by move desc, symbol, exchange) a, row_number() over (order by move, symbol, exchange) z from m) select symbol, exchange, round(move, 6) as move, case when a <= 10 then 'top' else 'bottom' end as side from t where a <= 10 or z <= 10"))(
    lambda s, d: daily(s, d).groupBy("symbol", "exchange").agg((F.max_by("close", "day") / F.min_by("close", "day") - 1).alias("move")).withColumn("a", F.row_number().over(Window.orderBy(F.desc("move"), "symbol", "exchange"))).withColumn("z", F.row_number().over(Window.orderBy("move", "symbol", "exchange")))
    .where("a <= 10 or z <= 10").select("symbol", "exchange", F.round("move", 6).alias("move"), F.when(F.col("a") <= 10, "top").otherwise("bottom").alias("side"))
)
R.add("s6_nan_last", "select symbol, exchange, interval, timestamp, row_number() over (partition by symbol, exchange, interval order by case when isfinite(close) then close end desc nulls last, timestamp, created_at, open, high, low, volume) as pos from (select distinct symbol, exchange, interval, timestamp, close, created_at, open, high, low, volume from market_data where interval = '1h')")(
    lambda s, d: table(s, d, "market_data").where("interval = '1h'").select("symbol", "exchange", "interval", "timestamp", "close", "created_at", "open", "high", "low", "volume").distinct()
    .withColumn("c", F.when(~F.isnan("close") & (F.abs("close") < float("inf")), F.col("close")))
    .select("symbol", "exchange", "interval", "timestamp", F.row_number().over(Window.partitionBy("symbol", "exchange", "interval").orderBy(F.desc_nulls_last("c"), "timestamp", "created_at", "open", "high", "low", "volume")).alias("pos"))
)
R.add("s7_newest", with_views("ticks", "select event_id, us from ticks order by us desc, event_id desc limit 50"))(lambda s, d: ticks(s, d).orderBy(F.desc("us"), F.desc("event_id")).limit(50).select("event_id", "us"))
R.add("s8_rank_variants", with_views("long", _RET + " select symbol, row_number() over (order by coalesce(avg(ret) / nullif(stddev_samp(ret), 0), -9e9) desc) as rank from r group by 1"))(
    lambda s, d: _ret(s, d).groupBy("symbol").agg((F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("sh")).select("symbol", F.row_number().over(Window.orderBy(F.desc(F.coalesce("sh", F.lit(-9e9))))).alias("rank"))
)
R.add("s10_largest_group", "select exchange, n from (select exchange, count(*) n from symtoken group by 1) order by n desc, exchange limit 3")(lambda s, d: table(s, d, "symtoken").groupBy("exchange").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "exchange").limit(3))
R.add("s12_keyset_page", with_views("ticks", "select event_id, us from ticks where us < epoch_us(timestamp '2024-01-20') order by us desc, event_id desc limit 100"))(
    lambda s, d: ticks(s, d).where(F.col("us") < F.unix_micros(F.lit("2024-01-20").cast("timestamp"))).orderBy(F.desc("us"), F.desc("event_id")).limit(100).select("event_id", "us")
)
R.add("s13_hash_split", "select symbol, (row_number() over (order by sha256(symbol)) - 1) % 2 as half from (select distinct symbol from market_data)")(
    lambda s, d: table(s, d, "market_data").select("symbol").distinct().select("symbol", ((F.row_number().over(Window.orderBy(F.sha2("symbol", 256))) - 1) % 2).alias("half"))
)

# ---- sets
R.add("u1_union_all", "select count(*) n from (select o_custkey from orders union all select c_custkey from customer)")(lambda s, d: table(s, d, "orders").select("o_custkey").union(table(s, d, "customer").select("c_custkey")).agg(F.count("*").alias("n")))
R.add("u2_union_distinct", with_views("chain", "select strike from chain where expiry = '1' union select strike from chain where expiry = '2'"))(lambda s, d: chain(s, d).where("expiry = '1'").select("strike").union(chain(s, d).where("expiry = '2'").select("strike")).distinct())
R.add("u3_common_strikes", with_views("chain", "select strike from chain group by 1 having count(distinct expiry) = (select count(distinct expiry) from chain)"))(
    lambda s, d: chain(s, d).groupBy("strike").agg(F.count_distinct("expiry").alias("n")).where(F.col("n") == chain(s, d).agg(F.count_distinct("expiry")).scalar()).select("strike")
)
R.add("u4_except", "select o_orderdate::date as day from orders except select min(o_orderdate)::date from orders")(lambda s, d: table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().exceptAll(table(s, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("day"))))
R.add("u5_distinct_sorted", "select distinct instrumenttype, exchange from symtoken")(lambda s, d: table(s, d, "symtoken").select("instrumenttype", "exchange").distinct().orderBy("instrumenttype", "exchange"))
R.add("u6_first_order_distinct", with_views("ticks", "select user_id, symbol, min(event_id) as first_id from ticks group by 1, 2"))(lambda s, d: ticks(s, d).groupBy("user_id", "symbol").agg(F.min("event_id").alias("first_id")))

# ---- reshaping
R.add("reshape_p1_price_matrix", with_views("long", "select day, " + ", ".join(f"max(case when symbol = '{x}' then round(close, 4) end) as \"{x}\"" for x in ("1-URGENT", "2-HIGH", "5-LOW")) + " from long group by 1"))(
    lambda s, d: long_series(s, d).withColumn("close", F.round("close", 4)).groupBy("day").pivot("symbol", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.max("close"))
)
R.add("reshape_p2_strike_side", with_views("chain", "select strike, max(case when side = 'CE' then oi end) as ce_oi, max(case when side = 'CE' then volume end) as ce_volume, max(case when side = 'PE' then oi end) as pe_oi, max(case when side = 'PE' then volume end) as pe_volume from chain where expiry = '1' group by 1"))(
    lambda s, d: chain(s, d).where("expiry = '1'").groupBy("strike").pivot("side", ["CE", "PE"]).agg(F.max("oi").alias("oi"), F.max("volume").alias("volume"))
    .select("strike", F.col("CE_oi").alias("ce_oi"), F.col("CE_volume").alias("ce_volume"), F.col("PE_oi").alias("pe_oi"), F.col("PE_volume").alias("pe_volume"))
)
R.add("reshape_p3_rank_grid", "select cast(r // 8 as int) as row, cast(r % 8 as int) as col, symbol from (select symbol, row_number() over (order by symbol) - 1 as r from (select distinct symbol from market_data))")(
    lambda s, d: table(s, d, "market_data").select("symbol").distinct().withColumn("r", F.row_number().over(Window.orderBy("symbol")) - 1).select(F.floor(F.col("r") / 8).cast("int").alias("row"), (F.col("r") % 8).cast("int").alias("col"), "symbol")
)
R.add("reshape_p4_year_month_matrix", with_views("long", _MON + " select symbol, cast(year(mo) as int) as year, " + ", ".join(f'max(case when month(mo) = {m} then round(ret, 6) end) as "{m}"' for m in range(1, 13)) + " from q where ret is not null group by 1, 2"))(
    lambda s, d: _monthly(s, d).withColumn("year", F.year("mo")).withColumn("m", F.month("mo")).withColumn("ret", F.round("ret", 6)).groupBy("symbol", "year").pivot("m", list(range(1, 13))).agg(F.max("ret"))
)
R.add("reshape_p6_unnest_chain", with_views("chain", "select expiry, strike, max(oi) filter (where side = 'CE') as ce_oi, max(oi) filter (where side = 'PE') as pe_oi from chain group by 1, 2"))(
    lambda s, d: chain(s, d).groupBy("expiry").agg(F.collect_list(F.struct("strike", "side", "oi")).alias("rows")).select("expiry", F.inline("rows")).groupBy("expiry", "strike").agg(F.max(F.when(F.col("side") == "CE", F.col("oi"))).alias("ce_oi"), F.max(F.when(F.col("side") == "PE", F.col("oi"))).alias("pe_oi"))
)
R.add("reshape_p7_aligned_cells", with_views("chain", ", c as (select expiry, strike, sum(oi) oi from chain group by 1, 2), g as (select s.strike, e.expiry, c.oi from (select distinct strike from c) s cross join (select distinct expiry from c) e left join c on c.strike = s.strike and c.expiry = e.expiry) select strike, array_to_string(list(coalesce(cast(cast(oi as bigint) as varchar), '-') order by expiry), ',') as cells from g group by 1"))(
    lambda s, d: align.full_grid(chain(s, d).groupBy("expiry", "strike").agg(F.sum("oi").alias("oi")), "strike", "expiry", "oi").groupBy("strike").agg(F.sort_array(F.collect_list(F.struct("expiry", F.coalesce(F.col("oi").cast("bigint").cast("string"), F.lit("-")).alias("v")))).alias("c")).select("strike", F.array_join(F.transform("c", lambda x: x.v), ",").alias("cells"))
)
R.add("reshape_p8_wide_to_long", with_views("bars", "select symbol, exchange, field, count(*) n, round(sum(v), 2) total from (unpivot (select symbol, exchange, open, high, low, close from bars where interval = '1h') on open, high, low, close into name field value v) group by 1, 2, 3"))(
    lambda s, d: bars(s, d).where("interval = '1h'").select("symbol", "exchange", "open", "high", "low", "close").unpivot(["symbol", "exchange"], ["open", "high", "low", "close"], "field", "v").groupBy("symbol", "exchange", "field").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))
)
