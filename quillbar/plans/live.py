"""Queries of streaming, risk and simulation operators, connectors and the rest."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbar.operators import align, archive, options, simulation, sip
from quillbar.operators.resample import tick_bars
from quillbar.operators.series import longest_runs
from quillbar.operators.snapshots import latest_futures
from quillbar.plans import Registry
from quillbar.plans.portfolio import _ret
from quillbar.session import shared_folder
from quillbar.sources import connectors
from quillbar.sources.tables import table
from quillbar.sources.views import LATEST_FUTURES, bars, chain, daily, legs, long_series, ticks, with_views
from quillbar.streaming import bars as live

R = Registry()


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(s, d):
    raw = live.stream_table(s, d, "events", table(s, d, "events").schema)
    t = raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("int").alias("size"), F.col("event_id").alias("seq"))
    return live.run_available(live.windowed_bars(t, "1 hour", "10 minutes"), _folder(s))


_WM = ", wm as (select (max(us) - 600000000) // 1000 * 1000 as w from ticks)"
R.add("st1_streamed_bars", with_views("ticks", _WM + """ select symbol, cast(us // 3600000000 * 3600 as bigint) as bucket, arg_min(price, (us, event_id)) as open, max(price) high, min(price) low, arg_max(price, (us, event_id)) as close, cast(sum(size) as bigint) volume, count(*) n
    from ticks group by 1, 2 having (us // 3600000000 + 1) * 3600000000 <= (select w from wm)""".replace("having (us // 3600000000 + 1) * 3600000000", "having (max(us) // 3600000000 + 1) * 3600000000")))(_stream)  # fmt: skip


def _feed(s, d):
    """Events as a feed in which every 13th tick arrives late by ten places."""
    t = ticks(s, d).withColumn("seq", F.col("event_id") + F.when(F.col("event_id") % 13 == 0, 10).otherwise(0))
    cum = F.sum("size").over(Window.partitionBy("symbol").orderBy("us", "event_id"))
    return t.select("symbol", "seq", (F.col("us") / 1e6).alias("ts"), "price", cum.cast("double").alias("volume"))


R.add("st4_late_ticks")(lambda s, d: live.closing_bars_batch(_feed(s, d), 3600))
R.add("st6_forming_bar", with_views("ticks", "select symbol, max(us // 3600000000 * 3600) as bucket, count(*) filter (where us // 3600000000 = (select max(m.us // 3600000000) from ticks m where m.symbol = t.symbol)) as n from ticks t group by 1"))(
    lambda s, d: tick_bars(ticks(s, d), 3600).groupBy("symbol").agg(F.max("bucket").alias("bucket"), F.max_by("n", "bucket").alias("n"))
)
R.add("st10_tick_warnings", with_views("ticks", """, l as (select symbol, event_id, abs(price / lag(price) over w - 1) > 0.2 as jumped, us - lag(us) over w > 1800000000 as stale from ticks window w as (partition by symbol order by us, event_id)) select * from l where jumped or stale"""))(
    lambda s, d: live.warnings(ticks(s, d), 0.2, 1800)
)
R.add("st15_reconcile", with_views("ticks", """, b as (select symbol, us // 3600000000 * 3600 as bucket, count(*) n, arg_max(price, (us, event_id)) as close from ticks group by 1, 2)
    select symbol, cast(bucket as bigint) as bucket, case when bucket % 7200 = 0 then close + 1 else close end as close from b"""))(
    lambda s, d: live.reconcile(tick_bars(ticks(s, d), 3600).where("bucket % 7200 = 0").select("symbol", "bucket", (F.col("close") + 1).alias("close")), tick_bars(ticks(s, d), 3600).select("symbol", "bucket", "close"))
)
def _watched(s, d):
    """Ticks as prices of positions, one per symbol and user, that the first tick opens: both sides, all trails."""
    k, mode = ["symbol", "user_id"], F.col("user_id") % 3
    first = F.first("price").over(Window.partitionBy(*k).orderBy("us", "event_id"))
    long = F.col("user_id") % 2 == 0
    away = lambda far: F.when(long, F.col("entry") * (1 - far)).otherwise(F.col("entry") * (1 + far))
    t = ticks(s, d).where("price is not null and user_id is not null").select(*k, "us", "event_id", "price", F.when(long, "BUY").otherwise("SELL").alias("side"), first.alias("entry"))
    return t.select(
        "*", away(0.5).alias("stop"), away(-0.9).alias("target"), F.when(mode == 0, "none").when(mode == 1, "continuous").otherwise("stepped").alias("trail_mode"),
        (F.col("entry") * 0.1).alias("trail_trigger"), (F.col("entry") * 0.05).alias("trail_step"),
    )


_RISK_SQL = with_views("ticks", """, k as (select symbol, user_id, us, event_id, price as p, case when user_id % 2 = 0 then 1.0::double else -1.0::double end as d, user_id % 3 as mode, first_value(price) over w as e
      from ticks where price is not null and user_id is not null window w as (partition by symbol, user_id order by us, event_id)),
    l as (select *, e * (1 - d * 0.5) as s, e * (1 + d * 0.9) as t, max(d * p) over (partition by symbol, user_id order by us, event_id rows unbounded preceding) as best from k),
    g as (select *, greatest(0, best - d * e) as gain from l),
    v as (select *, greatest(d * s, case when gain > 0 and gain >= e * 0.1 and mode <> 0 then least(best, case mode when 1 then best - e * 0.05 when 2 then d * s + floor(gain / (e * 0.1)) * (e * 0.05) end) end) as level from g),
    x as (select *, case when d * p <= level then 'stop' when d * p >= d * t then 'target' end as why from v),
    o as (select *, coalesce(count(why) over (partition by symbol, user_id order by us, event_id rows between unbounded preceding and 1 preceding), 0) > 0 as out from x)
    select symbol, user_id, us, event_id, case when not out then round(abs(level), 6) end as stop_level, case when not out then why end as exit from o""")
_SHOWN = lambda r: r.withColumn("stop_level", F.round("stop_level", 6))
R.add("sim8_position_risk", _RISK_SQL)(lambda s, d: _SHOWN(simulation.position_risk(_watched(s, d), ["symbol", "user_id"], ["us", "event_id"])))
R.add("st12_risk_monitor", _RISK_SQL)(lambda s, d: _SHOWN(simulation.risk_monitor(_watched(s, d), ["symbol", "user_id"], ["us", "event_id"])))
R.add("sim9_account_risk", with_views("ticks", """, p as (select symbol as account, us * 1000 + event_id % 1000 as ts, sum(case when event_id % 2 = 0 then size else -size end) over (partition by symbol order by us, event_id) as pnl from ticks),
    q as (select *, max(pnl) over (partition by account order by ts) as peak, min(pnl) over (partition by account order by ts) as trough from p), f as (select *, case when peak >= 200 then greatest(0, peak - 100) end as floor from q)
    select account, ts, cast(pnl as double) pnl, cast(peak as double) peak, cast(trough as double) trough, cast(floor as double) as floor, case when pnl <= -500 then 'stop' when floor is not null and pnl <= floor then 'lock' when pnl >= 2000 then 'target' end as trigger from f"""))(
    lambda s, d: simulation.account_risk(
        ticks(s, d).select(F.col("symbol").alias("account"), (F.col("us") * 1000 + F.col("event_id") % 1000).alias("ts"), F.sum(F.when(F.col("event_id") % 2 == 0, F.col("size")).otherwise(-F.col("size"))).over(Window.partitionBy("symbol").orderBy("us", "event_id")).cast("double").alias("pnl")),
        200.0, 100.0, 500.0, 2000.0)
)
R.add("sim10_trail_to_entry", """with p as (select id, action as side, case when filled_quantity > 0 then average_price::double end as entry, trigger_price::double as stop, price::double as price from sandbox_orders)
    select id, case when entry is null then 'no_entry' when case when side = 'BUY' then price <= entry else price >= entry end then 'through_price' when case when side = 'BUY' then stop >= entry else stop <= entry end then 'not_improving' else 'moves' end as action from p""")(
    lambda s, d: simulation.trail_to_entry(table(s, d, "sandbox_orders").select("id", F.col("action").alias("side"), F.when(F.col("filled_quantity") > 0, F.col("average_price").cast("double")).alias("entry"), F.col("trigger_price").cast("double").alias("stop"), F.col("price").cast("double").alias("price"))).select("id", "action")
)
R.add("sim14_folds", with_views("long", """, d as (select day, row_number() over (order by day) - 1 as i, count(*) over () as n from (select distinct day from long)), e as (select *, cast(floor(n * 0.8) as bigint) as dev, cast(floor(floor(n * 0.8) / 2) as bigint) as half from d),
    f as (select day, i, case when i >= dev then 'holdout' when i < half then 'initial' else 'test' end as role, case when i >= half and i < dev then cast(floor((i - half) / ceil((dev - half) / 3.0)) as int) + 1 end as fold from e)
    select day, i, role, fold, coalesce(lead(fold, 5) over (order by day), -1) > coalesce(fold, 0) as purged from f"""))(lambda s, d: simulation.folds(long_series(s, d)))  # fmt: skip
R.add("sim15_grid", with_views("long", """, g as (select n, k, (row_number() over (order by n, k)) - 1 as candidate from (values (5), (10), (20)) a(n), (values (2), (3)) b(k)),
    m as (select symbol, day, close / lag(close, 5) over w - 1 as m5, close / lag(close, 10) over w - 1 as m10, close / lag(close, 20) over w - 1 as m20, lead(close, 2) over w / close - 1 as f2, lead(close, 3) over w / close - 1 as f3 from long window w as (partition by symbol order by day))
    select candidate, n, k, count(*) as trades, round(avg(case k when 2 then f2 else f3 end), 7) as mean from m join g on case n when 5 then m5 when 10 then m10 else m20 end > 0 and case k when 2 then f2 else f3 end is not null group by 1, 2, 3"""))(lambda s, d: _grid(s, d))  # fmt: skip


def _grid(s, d):
    w = Window.partitionBy("symbol").orderBy("day")
    c = long_series(s, d)
    for n in (5, 10, 20):
        c = c.withColumn(f"m{n}", F.col("close") / F.lag("close", n).over(w) - 1)
    for k in (2, 3):
        c = c.withColumn(f"f{k}", F.lead("close", k).over(w) / F.col("close") - 1)
    cells = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k"), F.col(f"m{n}").alias("m"), F.col(f"f{k}").alias("f")) for n in (5, 10, 20) for k in (2, 3)])
    r = c.select(F.inline(cells)).where("m > 0 and f is not null").groupBy("n", "k").agg(F.count("*").alias("trades"), F.round(F.avg("f"), 7).alias("mean"))
    g = simulation.grid(s, n=[5, 10, 20], k=[2, 3]).select("candidate", F.col("n").cast("int").alias("n"), F.col("k").cast("int").alias("k"))
    return g.join(r, ["n", "k"])


def _straddle(s, d):
    b = bars(s, d).where("interval = '15m'").select(F.concat("symbol", F.lit("/"), "exchange").alias("symbol"), F.col("timestamp").alias("ts"), "close", "high", "low")
    return b.select("symbol", F.to_date(F.timestamp_seconds(F.col("ts") + 19800)).alias("day"), "ts", options.atm_strike(F.col("close"), F.lit(5.0)).alias("atm"), (F.col("high") - F.col("low") + F.col("close") * 0.01).alias("price"))


R.add("sim5_straddle")(lambda s, d: simulation.cumulative_days(simulation.straddle_days(_straddle(s, d), 5.0)))
R.add("o16_straddle_series", with_views("bars", "select symbol, exchange, timestamp, floor(close / 5.0 + 0.5) * 5.0 as atm, round(high - low + close * 0.01, 6) as straddle from bars where interval = '15m'"))(
    lambda s, d: bars(s, d).where("interval = '15m'").select("symbol", "exchange", "timestamp", options.atm_strike(F.col("close"), F.lit(5.0)).cast("double").alias("atm"), F.round(F.col("high") - F.col("low") + F.col("close") * 0.01, 6).alias("straddle"))
)
R.add("o19_calendar_spreads", f"""with k as (select *, row_number() over (partition by exchange, name order by e, symbol) as rank from {LATEST_FUTURES})
    select a.name, a.symbol as near, b.symbol as far, b.rank from k a join k b on a.exchange = b.exchange and a.name = b.name and a.rank = 1 and b.rank in (2, 3)""")(
    lambda s, d: align.calendar_pairs(
        align.neighbours(latest_futures(table(s, d, "symtoken")), ["exchange", "name"], [F.asc_nulls_last("expiry_on"), F.col("symbol")]).withColumn("z", F.lit(0)),
        ["exchange", "name"], "symbol", "z").select("name", "near", "far", "rank")
)
R.add("a11_chain_ratio", with_views("chain", "select expiry, round(coalesce(sum(oi) filter (where side = 'PE') / nullif(sum(oi) filter (where side = 'CE'), 0), 0), 2) as pcr from chain group by 1"))(
    lambda s, d: options.totals(chain(s, d)).select("expiry", F.col("pcr_oi").alias("pcr"))
)


def _matrix(ret):
    """Correlations of every member with every other; null where they share fewer than 20 days."""
    p = align.pair_correlations(ret).select("a", "b", "corr")
    own = ret.groupBy(F.col("symbol").alias("a"), F.col("symbol").alias("b")).agg(F.when(F.count("*") >= 20, F.lit(1.0)).alias("corr"))
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).unionByName(own)
    return both.groupBy("a").pivot("b").agg(F.round(F.max("corr"), 6))


_MEMBERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
R.add("a16_correlation_matrix", with_views("long", ", r as (select * from (select symbol, day, close / lag(close) over (partition by symbol order by day) - 1 as ret from long) where ret is not null), "
    "c as (select a.symbol as a, b.symbol as b, case when count(*) >= 20 then round(corr(a.ret, b.ret), 6) end as c from r a join r b on a.day = b.day group by 1, 2) "
    "select a, " + ", ".join(f"max(case when b = '{m}' then c end) as \"{m}\"" for m in _MEMBERS) + " from c group by 1"))(
    lambda s, d: _matrix(_ret(s, d))
)
R.add("a23_daily_means", with_views("legs", "select strategy, round(avg(m), 4) as mean_of_days from (select strategy, day, avg(price) as m from legs group by 1, 2) group by 1"))(
    lambda s, d: legs(s, d).groupBy("strategy", "day").agg(F.avg("price").alias("m")).groupBy("strategy").agg(F.round(F.avg("m"), 4).alias("mean_of_days"))
)
R.add("a27_priced_summary", with_views("legs", "select strategy, cast(count(*) filter (where symbol % 3 <> 0) as bigint) as priced, cast(count(*) filter (where symbol % 3 = 0) as bigint) as unpriced, round(sum(case when symbol % 3 <> 0 then qty * 10 else 0 end), 2) as mtm from legs group by 1"))(
    lambda s, d: legs(s, d).groupBy("strategy").agg(F.count_if(F.col("symbol") % 3 != 0).alias("priced"), F.count_if(F.col("symbol") % 3 == 0).alias("unpriced"), F.round(F.sum(F.when(F.col("symbol") % 3 != 0, F.col("qty") * 10).otherwise(0.0)), 2).alias("mtm"))
)
R.add("a36_mergeable_totals", with_views("ticks", "select symbol, count(*) n, round(sum(price), 3) as total from ticks group by 1"))(
    lambda s, d: ticks(s, d).groupBy("symbol", F.col("user_id") % 7).agg(F.count("*").alias("n"), F.sum("price").alias("t")).groupBy("symbol").agg(F.sum("n").alias("n"), F.round(F.sum("t"), 3).alias("total"))
)
R.add("j3_lagged_holdings", with_views("long", ", w as (select symbol, day, close / sum(close) over (partition by day) as w from long), l as (select symbol, day, lag(w) over (partition by symbol order by day) as w from w), r as (select symbol, day, close / lag(close) over (partition by symbol order by day) - 1 as ret from long) select r.day, round(sum(w * ret), 7) as net from r join l on l.symbol = r.symbol and l.day = r.day where ret is not null group by 1"))(
    lambda s, d: long_series(s, d).withColumn("w", F.col("close") / F.sum("close").over(Window.partitionBy("day"))).withColumn("lw", F.lag("w").over(Window.partitionBy("symbol").orderBy("day"))).withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("day")) - 1)
    .where("ret is not null").groupBy("day").agg(F.round(F.sum(F.col("lw") * F.col("ret")), 7).alias("net"))
)
R.add("w13_contiguous_guard", with_views("daily", """, c as (select exchange, session_date, row_number() over (partition by exchange order by session_date) n from trading_calendar), j as (select d.symbol, d.exchange, d.day, d.close, c.n from daily d join c on c.exchange = d.exchange and c.session_date = d.day)
    select symbol, exchange, day, case when n - lag(n, 9) over w = 9 then round(avg(close) over (partition by symbol, exchange order by day rows between 9 preceding and current row), 6) end as mean from j window w as (partition by symbol, exchange order by day)"""))(
    lambda s, d: daily(s, d).join(table(s, d, "trading_calendar").select("exchange", F.col("session_date").alias("day"), F.row_number().over(Window.partitionBy("exchange").orderBy("session_date")).alias("n")), ["exchange", "day"])
    .select("symbol", "exchange", "day", F.when(F.col("n") - F.lag("n", 9).over(Window.partitionBy("symbol", "exchange").orderBy("day")) == 9, F.round(F.avg("close").over(Window.partitionBy("symbol", "exchange").orderBy("day").rowsBetween(-9, 0)), 6)).alias("mean"))
)
R.add("rs3_gate", with_views("daily", """, f as (select symbol, exchange, day, close, avg(close) over w as m, count(close) over w as k from daily window w as (partition by symbol, exchange order by day rows between 19 preceding and current row))
    select symbol, exchange, day, case when k < 20 then null else not abs(close - m) <= 1e-12 * greatest(abs(close), abs(m)) and close > m end as pass from f"""))(
    lambda s, d: daily(s, d).withColumn("m", F.avg("close").over(Window.partitionBy("symbol", "exchange").orderBy("day").rowsBetween(-19, 0))).withColumn("k", F.count("close").over(Window.partitionBy("symbol", "exchange").orderBy("day").rowsBetween(-19, 0)))
    .select("symbol", "exchange", "day", F.when(F.col("k") >= 20, archive.strictly_above(F.col("close"), F.col("m"))).alias("pass"))
)
R.add("rs6_snapshot_validation", with_views("daily", "select exchange, count(*) n, cast(count(*) filter (where not (low <= least(open, close) and high >= greatest(open, close))) as bigint) as bad, cast(count(distinct symbol) as bigint) as symbols, min(day) first_day, max(day) last_day from daily group by 1"))(
    lambda s, d: daily(s, d).groupBy("exchange").agg(F.count("*").alias("n"), F.count_if(~archive.valid_bar()).alias("bad"), F.count_distinct("symbol").alias("symbols"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
)
R.add("rs9_condition_report", with_views("legs", """, t as (select strategy, price - 1500 - qty * 20 as pnl, case when day between date '1996-01-10' and date '1996-06-30' then 'c1' when day between date '1998-03-01' and date '1998-09-15' then 'c2' end as cond from legs)
    select strategy, cond, count(*) n, round(avg(pnl), 4) mean, round(avg((pnl > 0)::int), 6) win_rate from t where cond is not null group by 1, 2"""))(
    lambda s, d: align.range_join(legs(s, d).withColumn("u", F.unix_date("day")).withColumn("pnl", F.col("price") - 1500 - F.col("qty") * 20),
        s.createDataFrame([("c1", "1996-01-10", "1996-06-30"), ("c2", "1998-03-01", "1998-09-15")], "cond string, a string, z string").select("cond", F.unix_date(F.to_date("a")).alias("lo"), F.unix_date(F.to_date("z")).alias("hi")), "u", "lo", "hi", 128)
    .groupBy("strategy", "cond").agg(F.count("*").alias("n"), F.round(F.avg("pnl"), 4).alias("mean"), F.round(F.avg((F.col("pnl") > 0).cast("int")), 6).alias("win_rate"))
)
R.add("rs11_volume_admission", with_views("daily", ", m as (select symbol, exchange, day, avg(volume) over w as v, count(volume) over w as k from daily window w as (partition by symbol, exchange order by day rows between 20 preceding and 1 preceding)) select symbol, exchange, count(*) as days, cast(count(*) filter (where k = 20 and v >= 50000) as bigint) as admitted from m group by 1, 2"))(
    lambda s, d: daily(s, d).withColumn("v", F.avg("volume").over(Window.partitionBy("symbol", "exchange").orderBy("day").rowsBetween(-20, -1))).withColumn("k", F.count("volume").over(Window.partitionBy("symbol", "exchange").orderBy("day").rowsBetween(-20, -1)))
    .groupBy("symbol", "exchange").agg(F.count("*").alias("days"), F.count_if((F.col("k") == 20) & (F.col("v") >= 50000)).alias("admitted"))
)
R.add("rs21_progress", "select job_id, count(*) n, cast(count(*) filter (where status = 'success') as bigint) done, round(cast(count(*) filter (where status = 'success') as double) / count(*), 6) as share from (select distinct * from job_items) where job_id is not null group by 1")(
    lambda s, d: table(s, d, "job_items").distinct().where("job_id is not null").groupBy("job_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("done"), F.round(F.count_if(F.col("status") == "success") / F.count("*"), 6).alias("share"))
)
R.add("rs22_markers", with_views("daily", ", b as (select symbol, min(day) + 5 as lo, max(day) - 5 as hi from daily group by 1) select d.symbol, count(*) n from daily d join b using (symbol) where day between lo and hi and volume > 100000 group by 1"))(
    lambda s, d: daily(s, d).where("volume > 100000").join(daily(s, d).groupBy("symbol").agg(F.date_add(F.min("day"), 5).alias("lo"), F.date_sub(F.max("day"), 5).alias("hi")), "symbol").where("day between lo and hi").groupBy("symbol").agg(F.count("*").alias("n"))
)
R.add("sp5_underwater", with_views("long", """, d as (select symbol, day, (close < 250000)::int as f, row_number() over (partition by symbol order by day) as rn from long), g as (select symbol, count(*) as length, min(day) as start, max(day) as "end" from (select *, rn - sum(f) over (partition by symbol order by day) as i from d) where f = 1 group by symbol, i)
    select symbol, length, start, "end" from (select *, row_number() over (partition by symbol order by length desc, start) q from g) where q = 1"""))(lambda s, d: longest_runs(long_series(s, d), F.col("close") < 250000))  # fmt: skip
R.add("sp9_frequencies")(lambda s, d: _frequencies(s, d))


def _frequencies(s, d):
    out = None
    last = long_series(s, d).groupBy("symbol").agg(F.max_by("close", "day").alias("close"))
    span = long_series(s, d).groupBy("symbol").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    for rule, per_year in (("weekly", 52), ("fortnightly", 26), ("monthly", 12), ("quarterly", 4)):
        x = sip.schedule(span, long_series(s, d), rule).join(long_series(s, d).withColumnRenamed("day", "session"), ["symbol", "session"]).withColumn("amount", F.lit(12_000_000.0 / per_year))
        h = sip.headline(sip.run_plan(x, whole=False), last).select(F.lit(rule).alias("rule"), "symbol", "installments", F.round("multiple", 6).alias("multiple"))
        out = h if out is None else out.unionByName(h)
    return out


R.add("sp11_crisis_plans", with_views("long", """, c(name, a, z) as (values ('c1', date '1996-01-10', date '1996-12-30'), ('c2', date '1998-03-01', date '1999-02-15')), m as (select name, symbol, date_trunc('month', day) as mo, arg_min(close, day) as buy, max(day) as d1, arg_max(close, day) as fin from long join c on day between a and z group by 1, 2, 3)
    select name, symbol, count(*) as buys, round(sum(1000 / buy) * arg_max(fin, d1) / (1000 * count(*)), 6) as multiple from m group by 1, 2"""))(
    lambda s, d: align.range_join(long_series(s, d).withColumn("u", F.unix_date("day")), s.createDataFrame([("c1", "1996-01-10", "1996-12-30"), ("c2", "1998-03-01", "1999-02-15")], "name string, a string, z string").select("name", F.unix_date(F.to_date("a")).alias("lo"), F.unix_date(F.to_date("z")).alias("hi")), "u", "lo", "hi", 128)
    .groupBy("name", "symbol", F.trunc("day", "month").alias("mo")).agg(F.min_by("close", "day").alias("buy"), F.max("day").alias("d1"), F.max_by("close", "day").alias("fin"))
    .groupBy("name", "symbol").agg(F.count("*").alias("buys"), F.round(F.sum(1000 / F.col("buy")) * F.max_by("fin", "d1") / (F.count("*") * 1000), 6).alias("multiple"))
)
R.add("sim7_forward_entry", with_views("long", ", q as (select symbol, day from long where close > 300000) select q.symbol, q.day, (select min(l.day) from long l where l.symbol = q.symbol and l.day > q.day) as entry from q"))(
    lambda s, d: align.asof_forward(long_series(s, d).where("close > 300000").select("symbol", F.date_add("day", 1).alias("day")), long_series(s, d), "symbol", "day").select("symbol", F.date_sub("day", 1).alias("day"), F.col("matched_at").alias("entry"))
)
R.add("src16_sine_bars")(lambda s, d: connectors.sine_bars(s, ["AAA", "BBB", "CCC"], "2026-01-01", 60))
R.add("src17_calendar", "select session_date from (select unnest(generate_series(date '2026-01-01', date '2026-03-31', interval 1 day))::date as session_date) where session_date = date '2026-02-01' or (isodow(session_date) < 6 and session_date <> date '2026-01-26')")(
    lambda s, d: connectors.weekdays(s, "2026-01-01", "2026-03-31", ["2026-01-26"], ["2026-02-01"])
)
R.add("src14_chain_snapshot", with_views("chain", "select * from chain"))(
    lambda s, d: connectors.chain_rows(options.wide(chain(s, d)).groupBy("expiry").agg(F.collect_list(F.struct("strike",
        F.when(F.col("ce_oi").isNotNull(), F.struct(F.col("ce_oi").alias("oi"), F.col("ce_volume").alias("volume"), F.col("ce_ltp").alias("ltp"))).alias("ce"),
        F.when(F.col("pe_oi").isNotNull(), F.struct(F.col("pe_oi").alias("oi"), F.col("pe_volume").alias("volume"), F.col("pe_ltp").alias("ltp"))).alias("pe"))).alias("chain")))
)
R.add("src9_signal_intake", with_views("daily", "select symbol, day as signal_date from daily where exchange = 'NSE' and volume > 100000 group by 1, 2"))(
    lambda s, d: connectors.signals(daily(s, d).where("volume > 100000 and exchange = 'NSE'").select(F.date_format("day", "dd-MM-yyyy").alias("Signal Date"), F.lower("symbol").alias("Ticker"), F.unix_date("day").alias("row")))[0].select("symbol", "signal_date")
)
R.add("snk11_touch_alerts", """with o as (select event_type as alert_type, max(value) as value, min(ts) as first_seen from events where event_type in ('error', 'click') group by 1), r as (select event_type as alert_type, arg_max(value, (ts, event_id)) as value, max(ts) as at from events where event_type in ('error', 'view') group by 1)
    select coalesce(o.alert_type, r.alert_type) as alert_type, coalesce(r.value, o.value) as value, case when o.alert_type is null then 'created' when r.alert_type is not null then 'touched' else 'kept' end as action from o full join r on o.alert_type = r.alert_type""")(
    lambda s, d: archive.touch_alerts(
        table(s, d, "events").where("event_type in ('error', 'click')").groupBy(F.col("event_type").alias("alert_type")).agg(F.max("value").alias("value"), F.min("ts").alias("first_seen")),
        table(s, d, "events").where("event_type in ('error', 'view')").groupBy(F.col("event_type").alias("alert_type")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("at"))).select("alert_type", "value", "action")
)
R.add("snk12_resolve_alerts", "select event_type as alert_type, max(value) as value, max(value) < 400 as resolved from events group by 1")(
    lambda s, d: archive.resolve_alerts(table(s, d, "events").groupBy(F.col("event_type").alias("alert_type")).agg(F.max("value").alias("value")), F.lit(400.0))
)
R.add("f2_pair_list", with_views("bars", "select symbol, exchange, count(*) n from bars where (symbol = 'ZINTARCONT' and exchange = 'MCX') or (symbol = 'ZINTARCONT' and exchange = 'NCDEX') group by 1, 2"))(
    lambda s, d: bars(s, d).join(s.createDataFrame([("ZINTARCONT", "MCX"), ("ZINTARCONT", "NCDEX")], "symbol string, exchange string"), ["symbol", "exchange"], "left_semi").groupBy("symbol", "exchange").agg(F.count("*").alias("n"))
)
R.add("f3_between", with_views("bars", "select interval, count(*) n from bars where timestamp between 1790000000 and 1791000000 group by 1"))(lambda s, d: bars(s, d).where(F.col("timestamp").between(1790000000, 1791000000)).groupBy("interval").agg(F.count("*").alias("n")))
R.add("f13_canonical_rows", with_views("bars", "select timestamp, open, high, low, close, volume, oi from bars where interval = '1h'"))(lambda s, d: connectors.check_history(bars(s, d).where("interval = '1h'")))
R.add("s11_newest_first", with_views("long", "select symbol, day, row_number() over (partition by symbol order by day desc) as pos from long"))(
    lambda s, d: long_series(s, d).select("symbol", "day", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day"))).alias("pos"))
)
R.add("sc3_parse_symbol", f"select distinct symbol, regexp_extract(symbol, '{options.SYMBOL_FORM}', 3) as strike from sandbox_orders where symbol is not null")(
    lambda s, d: table(s, d, "sandbox_orders").where("symbol is not null").select("symbol", options.parse_symbol(F.col("symbol"))["strike"].alias("strike")).distinct()
)
R.add("sp7_start_heatmap", with_views("long", """, m as (select symbol, cast(date_trunc('month', day) as date) mo, arg_min(close, day) buy, arg_max(close, day) fin from long group by 1, 2), x as (select *, (year(mo) - 1970) * 12 + month(mo) - 1 as i from m),
    s as (select x.symbol, x.i as s, n, x.mo from x join (select symbol, min(i) lo from x group by 1) l using (symbol), (values (12), (24), (36)) y(n) where (x.i - lo) % 6 = 0),
    c as (select s.symbol, s.mo as start, n // 12 as years, round(sum(1000 / buy) * arg_max(fin, x.i) / (n * 1000), 6) as multiple from s join x on x.symbol = s.symbol and x.i between s.s and s.s + n - 1 group by s.symbol, s.mo, n having count(*) = n)
    select symbol, start, max(case when years = 1 then multiple end) as y1, max(case when years = 2 then multiple end) as y2, max(case when years = 3 then multiple end) as y3 from c group by 1, 2"""))(
    lambda s, d: sip.rolling_plans(long_series(s, d), [1, 2, 3], 6, 1000.0).withColumn("multiple", F.round("multiple", 6)).groupBy("symbol", "start").pivot("years", [1, 2, 3]).agg(F.max("multiple")).toDF("symbol", "start", "y1", "y2", "y3")
)
