"""Queries of window and join operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbar.operators import align, series
from quillbar.operators.resample import tick_bars
from quillbar.operators.snapshots import latest_futures
from quillbar.plans import Registry
from quillbar.sources.tables import table
from quillbar.sources.views import LATEST_FUTURES, bars, chain, daily, legs, long_series, ticks, with_views

R = Registry()
r6 = lambda c: F.round(c, 6).alias(c)
_W = "over (partition by symbol order by day)"
_RET = ", r as (select * from (select symbol, day, close, close / lag(close) over (partition by symbol order by day) - 1 as ret from long) where ret is not null)"


def _ret(s, d):
    return series.returns(long_series(s, d))


R.add("w1_returns", with_views("long", _RET + " select symbol, day, round(ret, 6) as ret from r"))(lambda s, d: _ret(s, d).select("symbol", "day", r6("ret")))
R.add("w2_growth", with_views("long", f"select symbol, day, round(coalesce(close / lag(close) {_W}, 1), 6) as ratio from long"))(lambda s, d: series.growth(long_series(s, d)).select("symbol", "day", r6("ratio")))
R.add("w3_split_artifacts", with_views("long", _RET + " select symbol, count(*) n, string_agg(cast(day as varchar), ',' order by day) as days from r where abs(ret) > 0.35 group by 1"))(lambda s, d: series.large_moves(long_series(s, d)))
_UP = "over (partition by symbol order by day rows unbounded preceding)"
R.add("w4_drawdown", with_views("long", f"select symbol, day, round(max(close) {_UP}, 6) as peak, round(close / max(close) {_UP} - 1, 6) as drawdown from long"))(
    lambda s, d: series.drawdowns(long_series(s, d)).select("symbol", "day", r6("peak"), r6("drawdown"))
)
R.add("w5_recovery", with_views("long", f""", d as (select symbol, day, close, max(close) {_UP} as peak, close / max(close) {_UP} - 1 as dd from long),
    t as (select symbol, min(dd) as max_drawdown, arg_min(day, (dd, day)) as trough, arg_min(peak, (dd, day)) as peak from d group by 1)
    select t.symbol, round(max_drawdown, 6) as max_drawdown, trough, round(peak, 6) as peak, (select min(day) from d where d.symbol = t.symbol and d.day > t.trough and d.close >= t.peak) as recovered from t"""))(
    lambda s, d: series.max_drawdown(long_series(s, d)).select("symbol", r6("max_drawdown"), "trough", r6("peak"), "recovered")
)
R.add("w6_longest_underwater", with_views("long", f""", d as (select symbol, day, (close < max(close) {_UP})::int as f, row_number() {_W} as rn from long),
    g as (select symbol, count(*) as length, min(day) as start, max(day) as "end" from (select *, rn - sum(f) {_UP} as i from d) where f = 1 group by symbol, i)
    select symbol, length, start, "end" from (select *, row_number() over (partition by symbol order by length desc, start) q from g) where q = 1"""))(
    lambda s, d: series.longest_runs(series.drawdowns(long_series(s, d)), F.col("drawdown") < 0)
)
R.add("w7_current_run", with_views("long", f""", l as (select symbol, day, case when close > lag(close) {_W} then 'up' else 'down' end as label from long),
    c as (select *, sum(case when prev is not distinct from label then 0 else 1 end) {_UP} as g from (select *, lag(label) {_W} as prev from l))
    select symbol, max(label) as label, count(*) as bars from c where (symbol, g) in (select symbol, max(g) from c group by 1) group by symbol"""))(
    lambda s, d: series.current_run(long_series(s, d), F.when(F.col("close") > F.lag("close").over(series.by()), "up").otherwise("down"))
)


def _frame(name: str, n: int, spark_agg, sql_agg: str, src: str = "close") -> None:
    fr = f"over (partition by symbol order by day rows between {n - 1} preceding and current row)"
    sql = with_views("long", f"{_RET} select symbol, day, case when count({src}) {fr} = {n} then round({sql_agg.format(f=fr)}, 6) end as value from r")
    R.add(name, sql)(lambda s, d: _ret(s, d).select("symbol", "day", F.round(series.full(spark_agg(), n, src, series.trailing(series.by(), n)), 6).alias("value")))


_frame("w8_mean_200", 200, lambda: F.avg("close"), "avg(close) {f}")
_frame("w9_volatility_20", 20, lambda: F.stddev_samp("ret"), "stddev_samp(ret) {f}", "ret")
R.add("w10_path_efficiency", with_views("long", f""", d as (select *, abs(close - lag(close) {_W}) as m from long),
    e as (select *, sum(m) over (partition by symbol order by day rows between 19 preceding and current row) as p, count(m) over (partition by symbol order by day rows between 19 preceding and current row) as k, lag(close, 20) {_W} as c20 from d)
    select symbol, day, round(case when k = 20 and p = 0 then 0.0 when k = 20 then abs(close - c20) / p end, 6) as efficiency from e"""))(lambda s, d: series.efficiency(long_series(s, d)).select("symbol", "day", r6("efficiency")))  # fmt: skip
_F60 = "over (partition by symbol order by day rows between 59 preceding and current row)"
R.add("w11_drawdown_60", with_views("long", f"select symbol, day, round(greatest(0, 1 - close / max(close) {_F60}), 6) as drawdown from long"))(
    lambda s, d: long_series(s, d).select("symbol", "day", F.round(F.greatest(F.lit(0.0), 1 - F.col("close") / F.max("close").over(series.trailing(series.by(), 60))), 6).alias("drawdown"))
)
R.add("w12_midrank_percentile", with_views("long", """, n as (select *, row_number() over (partition by symbol order by day) rn from long)
    select a.symbol, a.day, case when count(b.rn) = 90 then round((count(*) filter (where b.close < a.close - (1e-12 + 1e-9 * abs(a.close))) + 0.5 * count(*) filter (where abs(b.close - a.close) <= 1e-12 + 1e-9 * abs(a.close))) * 100.0 / 90, 6) end as midrank
    from n a left join n b on a.symbol = b.symbol and b.rn between a.rn - 90 and a.rn - 1 group by a.symbol, a.day"""))(lambda s, d: series.midrank(long_series(s, d)).select("symbol", "day", r6("midrank")))  # fmt: skip
R.add("w14_ffill", with_views("ticks", "select symbol, event_id, last_value(case when size > 50 then price end ignore nulls) over (partition by symbol order by us, event_id rows unbounded preceding) as filled from ticks"))(
    lambda s, d: ticks(s, d).withColumn("v", F.when(F.col("size") > 50, F.col("price"))).select("symbol", "event_id", F.last("v", ignorenulls=True).over(series.upto(Window.partitionBy("symbol").orderBy("us", "event_id"))).alias("filled"))
)
R.add("w15_keep_first_last", with_views("ticks", "select user_id, symbol, arg_min(event_id, (us, event_id)) as first_id, arg_max(event_id, (us, event_id)) as last_id from ticks group by 1, 2"))(
    lambda s, d: ticks(s, d).groupBy("user_id", "symbol").agg(F.min_by("event_id", F.struct("us", "event_id")).alias("first_id"), F.max_by("event_id", F.struct("us", "event_id")).alias("last_id"))
)
R.add("w16_nearest_expiries", f"""select name, symbol, rank from (select name, symbol, row_number() over (partition by exchange, name order by e, symbol) as rank from {LATEST_FUTURES}) where rank <= 3""")(
    lambda s, d: align.neighbours(latest_futures(table(s, d, "symtoken")), ["exchange", "name"], [F.asc_nulls_last("expiry_on"), F.col("symbol")]).select("name", "symbol", "rank")
)
R.add("w17_nth_from_last", with_views("daily", "select symbol, exchange, day, oi from (select *, row_number() over (partition by symbol, exchange order by day desc) r from daily) where r = 2"))(
    lambda s, d: daily(s, d).withColumn("r", F.row_number().over(Window.partitionBy("symbol", "exchange").orderBy(F.desc("day")))).where("r = 2").select("symbol", "exchange", "day", "oi")
)
R.add("w18_growth_curve", with_views("long", f"{_RET} select symbol, day, round(exp(sum(ln(1 + ret)) {_UP}), 6) as curve from r"))(
    lambda s, d: _ret(s, d).select("symbol", "day", F.round(F.exp(F.sum(F.log1p("ret")).over(series.upto(series.by()))), 6).alias("curve"))
)
R.add("w19_longest_valid_run", with_views("daily", """, d as (select symbol || '/' || exchange as symbol, day, (volume > 0)::int as f, row_number() over (partition by symbol, exchange order by day) rn from daily),
    g as (select symbol, count(*) as length, min(day) as start, max(day) as "end" from (select *, rn - sum(f) over (partition by symbol order by day rows unbounded preceding) as i from d) where f = 1 group by symbol, i)
    select symbol, length, start, "end" from (select *, row_number() over (partition by symbol order by length desc, start) q from g) where q = 1"""))(
    lambda s, d: series.longest_runs(daily(s, d).withColumn("symbol", F.concat("symbol", F.lit("/"), "exchange")), F.col("volume") > 0)
)
R.add("w20_min_drop", with_views("long", f", d as (select symbol, close / max(close) {_UP} - 1 as dd from long) select symbol, round(min(dd), 6) as drop from d group by 1"))(
    lambda s, d: series.drawdowns(long_series(s, d)).groupBy("symbol").agg(F.round(F.min("drawdown"), 6).alias("drop"))
)
R.add("w21_weighted_mean", with_views("long", f"select symbol, day, round((3 * close + 2 * lag(close, 1) {_W} + lag(close, 2) {_W}) / 6.0, 6) as wma from long"))(
    lambda s, d: long_series(s, d).select("symbol", "day", F.round(series.weighted_mean("close", 3, series.by()), 6).alias("wma"))
)
R.add("w22_weights", with_views("legs", ", t as (select symbol, sum(qty) q from legs group by 1) select symbol, round(q / sum(q) over (), 8) as weight from t"))(
    lambda s, d: legs(s, d).groupBy("symbol").agg(F.sum("qty").alias("q")).select("symbol", F.round(F.col("q") / legs(s, d).agg(F.sum("qty")).scalar(), 8).alias("weight"))
)
R.add("w23_month_over_month", with_views("long", """, m as (select symbol, cast(date_trunc('month', day) as date) as month, arg_max(close, day) as value from long group by 1, 2)
    select symbol, month, round(value / lag(value) over (partition by symbol order by month) - 1, 6) as change from m"""))(lambda s, d: series.month_over_month(long_series(s, d)).select("symbol", "month", r6("change")))  # fmt: skip
R.add("w24_lagged_weights", with_views("long", """, t as (select day, sum(close) s from long group by 1), w as (select symbol, long.day, close / s as w from long join t on t.day = long.day)
    select symbol, day, round(lag(w) over (partition by symbol order by day), 6) as lagged from w"""))(
    lambda s, d: long_series(s, d).withColumn("w", F.col("close") / F.sum("close").over(Window.partitionBy("day"))).select("symbol", "day", F.round(F.lag("w").over(series.by()), 6).alias("lagged"))
)
_A5 = "avg(close) over (partition by symbol order by day rows between 4 preceding and current row)"
_A20 = "avg(close) over (partition by symbol order by day rows between 19 preceding and current row)"
R.add("w25_crossovers", with_views("long", f""", a as (select symbol, day, {_A5} as f, {_A20} as s from long), b as (select *, lag(f) {_W} as pf, lag(s) {_W} as ps from a)
    select symbol, day, case when pf < ps and f > s then 'up' else 'down' end as side from b where (pf < ps and f > s) or (pf > ps and f < s)"""))(
    lambda s, d: long_series(s, d).select("symbol", "day", F.avg("close").over(series.trailing(series.by(), 5)).alias("f"), F.avg("close").over(series.trailing(series.by(), 20)).alias("s"))
    .withColumn("pf", F.lag("f").over(series.by())).withColumn("ps", F.lag("s").over(series.by()))
    .where("(pf < ps and f > s) or (pf > ps and f < s)").select("symbol", "day", F.when(F.col("f") > F.col("s"), "up").otherwise("down").alias("side"))
)
R.add("w26_previous_close", with_views("daily", "select symbol, exchange, day, case when day = date '2026-10-30' then lag(close) over (partition by symbol, exchange order by day) else close end as previous from daily qualify row_number() over (partition by symbol, exchange order by day desc) = 1"))(
    lambda s, d: daily(s, d).withColumn("p", F.lag("close").over(Window.partitionBy("symbol", "exchange").orderBy("day"))).withColumn("r", F.row_number().over(Window.partitionBy("symbol", "exchange").orderBy(F.desc("day"))))
    .where("r = 1").select("symbol", "exchange", "day", F.when(F.col("day") == F.lit("2026-10-30").cast("date"), F.col("p")).otherwise(F.col("close")).alias("previous"))
)
R.add("w27_walk_forward_windows", with_views("long", """, n as (select symbol, day, close, row_number() over (partition by symbol order by day) - 1 r, count(*) over (partition by symbol) c from long),
    w as (select distinct symbol, unnest(generate_series(0, (c - 504) // 126)) as window_id from n where c >= 504)
    select w.symbol, window_id, min(day) as start, max(day) as "end", round(arg_max(close, day) / arg_min(close, day) - 1, 6) as total_return, count(*) as "rows"
    from w join n on n.symbol = w.symbol and n.r between window_id * 126 and window_id * 126 + 503 group by 1, 2"""))(
    lambda s, d: series.walk_forward(long_series(s, d), 504, 126).withColumn("total_return", F.round("total_return", 6))
)
R.add("w28_count_trough", with_views("ticks", """, c as (select symbol, cast(make_timestamp(us) as date) as day, count(*) n from ticks group by 1, 2),
    m as (select *, sum(n) over (partition by symbol order by day rows between 7 preceding and 1 preceding) / 7.0 as mean7, count(n) over (partition by symbol order by day rows between 7 preceding and 1 preceding) k from c)
    select symbol, day, n, n < mean7 / 2 as trough from m where k = 7"""))(
    lambda s, d: ticks(s, d).groupBy("symbol", F.to_date(F.timestamp_micros("us")).alias("day")).agg(F.count("*").alias("n"))
    .withColumn("m", F.sum("n").over(series.by().rowsBetween(-7, -1)) / 7.0).withColumn("k", F.count("n").over(series.by().rowsBetween(-7, -1)))
    .where("k = 7").select("symbol", "day", "n", (F.col("n") < F.col("m") / 2).alias("trough"))
)
R.add("w29_prior_volume", with_views("daily", """, m as (select symbol, exchange, day, volume, avg(volume) over w as mean, count(volume) over w as k from daily window w as (partition by symbol, exchange order by day rows between 20 preceding and 1 preceding))
    select symbol, exchange, day, round(mean, 4) as prior_mean, volume > mean as admitted from m where k = 20"""))(
    lambda s, d: daily(s, d).withColumn("m", F.avg("volume").over(Window.partitionBy("symbol", "exchange").orderBy("day").rowsBetween(-20, -1)))
    .withColumn("k", F.count("volume").over(Window.partitionBy("symbol", "exchange").orderBy("day").rowsBetween(-20, -1)))
    .where("k = 20").select("symbol", "exchange", "day", F.round("m", 4).alias("prior_mean"), (F.col("volume") > F.col("m")).alias("admitted"))
)

# ---- joins
_PAIR = ("1-URGENT", "5-LOW")
R.add("j1_inner_align", with_views("long", "select symbol, day, round(close, 4) as close from long where day in (select day from long group by 1 having count(distinct symbol) = (select count(distinct symbol) from long))"))(
    lambda s, d: align.inner_align(long_series(s, d), "symbol", "day").select("symbol", "day", F.round("close", 4).alias("close"))
)
R.add("j2_pair_inner", with_views("long", f"{_RET} select a.day, round(a.ret, 6) as p, round(b.ret, 6) as b from r a join r b on a.day = b.day where a.symbol = '1-URGENT' and b.symbol = '5-LOW'"))(
    lambda s, d: _ret(s, d).where("symbol = '1-URGENT'").select("day", F.round("ret", 6).alias("p")).join(_ret(s, d).where("symbol = '5-LOW'").select("day", F.round("ret", 6).alias("b")), "day")
)
R.add("j4_reindex", with_views("long", f", a as (select distinct day from long) select a.day, round(l.close, 4) as close from a left join long l on l.day = a.day and l.symbol = '5-LOW'"))(
    lambda s, d: long_series(s, d).select("day").distinct().join(long_series(s, d).where("symbol = '5-LOW'").select("day", F.round("close", 4).alias("close")), "day", "left")
)
R.add("j5_both_sides", with_views("chain", "select c.expiry, c.strike, round(c.ltp + p.ltp, 6) as straddle, round(c.strike + c.ltp - p.ltp, 6) as synthetic from chain c join chain p on c.expiry = p.expiry and c.strike = p.strike and c.side = 'CE' and p.side = 'PE'"))(
    lambda s, d: chain(s, d).where("side = 'CE'").select("expiry", "strike", F.col("ltp").alias("c")).join(chain(s, d).where("side = 'PE'").select("expiry", "strike", F.col("ltp").alias("p")), ["expiry", "strike"])
    .select("expiry", "strike", F.round(F.col("c") + F.col("p"), 6).alias("straddle"), F.round(F.col("strike") + F.col("c") - F.col("p"), 6).alias("synthetic"))
)
_LEGS = [("1-URGENT", 1.0), ("3-MEDIUM", -2.0), ("5-LOW", 1.0)]
R.add("j6_all_legs_premium", with_views("long", "select day, round(sum(sign * close), 4) as premium from long join (values ('1-URGENT', 1.0), ('3-MEDIUM', -2.0), ('5-LOW', 1.0)) l(symbol, sign) using (symbol) group by 1 having count(*) = 3"))(
    lambda s, d: align.all_legs(long_series(s, d), s.createDataFrame(_LEGS, "symbol string, sign double"), "day").select("day", F.round("premium", 4).alias("premium"))
)
R.add("j7_common_instants", with_views("daily", "select exchange, day, count(*) n from daily where exchange in ('NSE', 'BSE') group by 1, 2 having count(*) > 1"))(
    lambda s, d: daily(s, d).where("exchange in ('NSE', 'BSE')").groupBy("exchange", "day").agg(F.count("*").alias("n")).where("n > 1")
)
R.add("j8_grid", with_views("chain", ", c as (select expiry, strike, sum(oi) oi from chain group by 1, 2) select s.strike, e.expiry, c.oi from (select distinct strike from c) s cross join (select distinct expiry from c) e left join c on c.strike = s.strike and c.expiry = e.expiry"))(
    lambda s, d: align.full_grid(chain(s, d).groupBy("expiry", "strike").agg(F.sum("oi").alias("oi")), "strike", "expiry", "oi")
)
R.add("j10_inner_join", "select c_mktsegment, count(*) n from orders join customer on o_custkey = c_custkey group by 1")(
    lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))
)
R.add("j11_left_two_columns", "select count(*) n, cast(count(l_orderkey) as bigint) matched from orders left join lineitem on o_orderkey = l_orderkey and cast(o_orderdate as date) = cast(l_shipdate as date)")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day")).join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("day"), F.lit(1).alias("m")), ["k", "day"], "left")
    .agg(F.count("*").alias("n"), F.count("m").alias("matched"))
)
R.add("j13_pair_correlation", with_views("long", f"{_RET} select a.symbol as a, b.symbol as b, count(*) n, round(case when count(*) >= 20 then corr(a.ret, b.ret) end, 6) as corr from r a join r b on a.day = b.day and a.symbol < b.symbol group by 1, 2"))(
    lambda s, d: align.pair_correlations(_ret(s, d)).withColumn("corr", F.round("corr", 6))
)
R.add("j14_asof_backward", with_views("ticks", """select a.event_id, a.symbol, b.us as matched_at, b.price as asof_price from (select * from ticks where symbol = 'purchase') a asof left join (select user_id, us, price from ticks where symbol = 'view') b on a.user_id = b.user_id and a.us > b.us"""))(
    lambda s, d: align.asof_backward(ticks(s, d).where("symbol = 'purchase'").select("event_id", "symbol", "user_id", "us"), ticks(s, d).where("symbol = 'view'"), "user_id", "us", ["price"]).drop("user_id", "us")
)
R.add("j15_asof_forward", with_views("long", """, q as (select 'm' || m as id, symbol, make_date(1995 + m // 12, m % 12 + 1, 15) as day from (select distinct symbol from long), (select unnest(generate_series(0, 79)) m))
    select id, symbol, day, (select min(l.day) from long l where l.symbol = q.symbol and l.day >= q.day) as matched_at from q"""))(
    lambda s, d: align.asof_forward(
        long_series(s, d).select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(0), F.lit(79))).alias("m"))
        .select(F.concat(F.lit("m"), F.col("m")).alias("id"), "symbol", F.make_date(F.floor(F.lit(1995) + F.col("m") / 12).cast("int"), F.col("m") % 12 + 1, F.lit(15)).alias("day")),
        long_series(s, d), "symbol", "day").select("id", "symbol", "day", "matched_at")
)
_CRISES = [("c1", "1996-01-10", "1996-06-30"), ("c2", "1998-03-01", "1998-09-15"), ("c3", "1998-08-01", "1999-02-01")]
R.add("j16_crisis_windows", with_views("long", """select name, symbol, count(*) n, round(arg_max(close, day) / arg_min(close, day) - 1, 6) as move from long
    join (values ('c1', date '1996-01-10', date '1996-06-30'), ('c2', date '1998-03-01', date '1998-09-15'), ('c3', date '1998-08-01', date '1999-02-01')) c(name, a, z) on day between a and z group by 1, 2"""))(
    lambda s, d: align.range_join(long_series(s, d).withColumn("n0", F.unix_date("day")),
        s.createDataFrame(_CRISES, "name string, a string, z string").select("name", F.unix_date(F.to_date("a")).alias("lo"), F.unix_date(F.to_date("z")).alias("hi")), "n0", "lo", "hi", 90)
    .groupBy("name", "symbol").agg(F.count("*").alias("n"), F.round(F.max_by("close", "day") / F.min_by("close", "day") - 1, 6).alias("move"))
)
R.add("j17_nearest_strike", with_views("ticks", ", k as (select distinct 100.0::double + p_size * 10 as strike from part) select t.event_id, arg_min(k.strike, (abs(k.strike - t.price), k.strike)) as nearest from ticks t, k group by 1"))(
    lambda s, d: _nearest_strike(s, d)
)


def _nearest_strike(s, d):
    """One row per event; of several prices of one event the closest to a strike decides. Without parts there is no row."""
    k = table(s, d, "part").select(F.lit(1).alias("g"), (F.lit(100.0) + F.col("p_size") * 10).alias("strike"))
    t = ticks(s, d).select("event_id", "price", F.lit(1).alias("g")).where(k.agg(F.count("*") > 0).scalar())
    v = F.struct(F.col("price").isNull().alias("none"), F.abs(F.col("nearest") - F.col("price")).alias("far"), "nearest")
    return align.nearest(t, k, "g", "price", "strike").groupBy("event_id").agg(F.min(v).alias("v")).select("event_id", "v.nearest")


R.add("j18_semi", "select count(*) n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")(
    lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").agg(F.count("*").alias("n"))
)
R.add("j19_anti_new_tokens", "select distinct exchange, trim(token) as token from symtoken where snapshot_date = date '2026-10-19' and not exists (select 1 from symtoken o where o.snapshot_date = date '2026-09-14' and o.exchange = symtoken.exchange and trim(o.token) = trim(symtoken.token))")(
    lambda s, d: table(s, d, "symtoken").where("snapshot_date = date '2026-10-19'").select("exchange", F.trim("token").alias("token")).distinct()
    .join(table(s, d, "symtoken").where("snapshot_date = date '2026-09-14'").select("exchange", F.trim("token").alias("token")), ["exchange", "token"], "left_anti")
)
R.add("j20_catalog_metadata", with_views("bars", ", c as (select distinct symbol, exchange from bars), m as (select symbol, exchange, max(name) as name from symtoken group by 1, 2) select c.symbol, c.exchange, coalesce(name, c.symbol) as name from c left join m using (symbol, exchange)"))(
    lambda s, d: bars(s, d).select("symbol", "exchange").distinct().join(table(s, d, "symtoken").groupBy("symbol", "exchange").agg(F.max("name").alias("name")), ["symbol", "exchange"], "left")
    .select("symbol", "exchange", F.coalesce("name", "symbol").alias("name"))
)
R.add("j21_calendar_pairs", """with k as (select p_type, p_partkey, p_retailprice, row_number() over (partition by p_type order by p_size, p_partkey) as rank from part)
    select a.p_type, a.p_partkey as near, b.p_partkey as far, b.rank, round(b.p_retailprice - a.p_retailprice, 4) as spread from k a join k b on a.p_type = b.p_type and a.rank = 1 and b.rank in (2, 3)""")(
    lambda s, d: align.calendar_pairs(align.neighbours(table(s, d, "part"), "p_type", [F.col("p_size"), F.col("p_partkey")]), "p_type", "p_partkey", "p_retailprice").select("p_type", "near", "far", "rank", F.round("spread", 4).alias("spread"))
)
R.add("j22_expression", with_views("long", "select a.day, round((a.close + b.close) / 2, 4) as value from long a join long b on a.day = b.day and a.symbol = '1-URGENT' and b.symbol = '5-LOW'"))(
    lambda s, d: align.expression(long_series(s, d), list(_PAIR), "(A + B) / 2").select("day", F.round("value", 4).alias("value"))
)
_HALF = "select symbol, sum(qty) qty, sum(qty * price) / sum(qty) as price from legs where l_linenumber {} 3 group by 1"
R.add("j23_settlement_merge", with_views("legs", f", h as ({_HALF.format('<=')}), t as ({_HALF.format('>')}) select coalesce(h.symbol, t.symbol) as symbol, coalesce(h.qty, 0) + coalesce(t.qty, 0) as qty, round((coalesce(h.qty * h.price, 0) + coalesce(t.qty * t.price, 0)) / (coalesce(h.qty, 0) + coalesce(t.qty, 0)), 4) as price from h full join t on h.symbol = t.symbol"))(
    lambda s, d: align.merge_holdings(*[legs(s, d).where(c).groupBy("symbol").agg(F.sum("qty").alias("qty"), (F.sum(F.col("qty") * F.col("price")) / F.sum("qty")).alias("price")) for c in ("l_linenumber <= 3", "l_linenumber > 3")])
    .withColumn("price", F.round("price", 4))
)
R.add("j24_aligned_lookback", with_views("daily", """, a as (select s.symbol, s.day, s.close / lag(s.close, 20) over w - b.close / lag(b.close, 20) over w as rel, count(*) over (partition by s.symbol order by s.day rows between 20 preceding and current row) k
    from daily s join daily b on s.day = b.day and s.symbol = b.symbol and s.exchange = 'NSE' and b.exchange = 'BSE' window w as (partition by s.symbol order by s.day)) select symbol, day, round(case when k = 21 then rel end, 6) as rel from a"""))(
    lambda s, d: daily(s, d).where("exchange = 'NSE'").select("symbol", "day", F.col("close").alias("x")).join(daily(s, d).where("exchange = 'BSE'").select("symbol", "day", F.col("close").alias("y")), ["symbol", "day"])
    .select("symbol", "day", F.round(F.when(F.count("*").over(series.trailing(series.by(), 21)) == 21, F.col("x") / F.lag("x", 20).over(series.by()) - F.col("y") / F.lag("y", 20).over(series.by())), 6).alias("rel"))
)
R.add("st2_volume_delta", with_views("ticks", """, b as (select symbol, us // 3600000000 as h, max(cum) as cum from (select *, sum(size) over (partition by symbol order by us, event_id rows unbounded preceding) as cum from ticks) group by 1, 2)
    select symbol, h, cast(greatest(0, coalesce(cum - lag(cum) over (partition by symbol order by h), 0)) as bigint) as volume from b"""))(
    lambda s, d: ticks(s, d).withColumn("cum", F.sum("size").over(series.upto(Window.partitionBy("symbol").orderBy("us", "event_id")))).groupBy("symbol", F.floor(F.col("us") / 3600000000).alias("h")).agg(F.max("cum").alias("cum"))
    .select("symbol", "h", F.greatest(F.lit(0), F.coalesce(F.col("cum") - F.lag("cum").over(series.by(order="h")), F.lit(0))).cast("bigint").alias("volume"))
)
R.add("st3_drop_partial_bucket", with_views("ticks", ", b as (select symbol, cast(us // 3600000000 * 3600 as bigint) as bucket, count(*) n from ticks group by 1, 2) select * from b where (symbol, bucket) not in (select symbol, min(bucket) from b group by 1)"))(
    lambda s, d: tick_bars(ticks(s, d), 3600).withColumn("m", F.min("bucket").over(Window.partitionBy("symbol"))).where("bucket <> m").select("symbol", "bucket", "n")
)
R.add("st8_unit_sniff", "select case when k % 2 = 0 then 'ms' else 's' end as unit, count(*) n from (select event_id as k from events) group by 1")(
    lambda s, d: table(s, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 0 + 1_700_000_000_000).otherwise(1_700_000_000).alias("t"))
    .groupBy(F.when(F.col("t") < 100_000_000_000, "s").otherwise("ms").alias("unit")).agg(F.count("*").alias("n"))
)
R.add("st14_snapshot_overlay", with_views("ticks", "select symbol, user_id, arg_max(price, (us, event_id)) as last_price from ticks group by 1, 2"))(
    lambda s, d: ticks(s, d).groupBy("symbol", "user_id").agg(F.max_by("price", F.struct("us", "event_id")).alias("last_price"))
)
