"""Queries of portfolio, investment-plan and research operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbar.operators import align, books, portfolio, research, sip
from quillbar.operators.resample import last_of_period
from quillbar.operators.series import by, returns, walk_forward
from quillbar.plans import Registry
from quillbar.sources.tables import table
from quillbar.sources.views import daily, legs, long_series, ticks, with_views

R = Registry()
_RET = ", r as (select * from (select symbol, day, close, close / lag(close) over (partition by symbol order by day) - 1 as ret from long) where ret is not null)"
_BEN = ", b as (select day, avg(ret) as b from r group by 1)"
_AL = ", al as (select * from long where day in (select day from long group by 1 having count(*) = 5))"
_WV = "(values ('1-URGENT', 3.0::double), ('2-HIGH', 2.0::double), ('3-MEDIUM', 2.0::double), ('4-NOT SPECIFIED', 2.0::double), ('5-LOW', 1.0::double)) w(symbol, w0)"
_W = [("1-URGENT", 3.0), ("2-HIGH", 2.0), ("3-MEDIUM", 2.0), ("4-NOT SPECIFIED", 2.0), ("5-LOW", 1.0)]


def _weights(s):
    return s.createDataFrame(_W, "symbol string, weight double")


def _ret(s, d):
    return returns(long_series(s, d))


def _bench(s, d):
    return _ret(s, d).groupBy("day").agg(F.avg("ret").alias("ret"))


def _aligned(s, d):
    return align.inner_align(long_series(s, d), "symbol", "day")


def r(n, *cols):
    return [F.round(c, n).alias(c) for c in cols]


R.add("sim2_weights", f"select symbol, round(w0 / 10, 8) as weight from {_WV}")(lambda s, d: portfolio.normalise_weights(_weights(s)).select("symbol", *r(8, "weight")))
R.add("sim1_buy_hold", with_views("long", _AL + f" select day, round(sum(w0 / 10 * close / f) * 100000, 4) as value, count(*) as members from (select *, first_value(close) over (partition by symbol order by day) as f from al) join {_WV} using (symbol) group by 1"))(
    lambda s, d: portfolio.buy_and_hold(_aligned(s, d), _weights(s), 100000.0).select("day", *r(4, "value"), "members")
)
R.add("sim1_calendar_rebalance", with_views("long", _AL + f""", p as (select *, date_trunc('month', day) as p, lag(close) over (partition by symbol order by day) as pb from al), q as (select *, first_value(coalesce(pb, close)) over (partition by symbol, p order by day) as st from p),
    g as (select day, p, sum(w0 / 10 * close / st) as g from q join {_WV} using (symbol) group by 1, 2), m as (select p, arg_max(g, day) as full_g from g group by 1), c as (select p, coalesce(sum(ln(full_g)) over (order by p rows between unbounded preceding and 1 preceding), 0) as l from m)
    select day, round(100000 * exp(l) * g, 3) as value from g join c using (p)"""))(lambda s, d: portfolio.calendar_rebalanced(_aligned(s, d), _weights(s), 100000.0).select("day", *r(3, "value")))  # fmt: skip


def _scenarios(s):
    rows = [(n, a, w, rule, band, cost, 100000.0) for n, rule, band, cost in (("hold", "none", 0.0, 0.001), ("month", "month", 0.0, 0.001), ("quarter", "quarter", 0.0, 0.001), ("year", "year", 0.0, 0.001), ("band", "band", 0.05, 0.001)) for a, w in _W]
    return s.createDataFrame(rows, "scenario string, symbol string, weight double, rule string, band double, cost_rate double, capital double")


R.add("sim1_backtest")(lambda s, d: portfolio.simulate(long_series(s, d), _scenarios(s)))
R.add("sim13_sweep")(
    lambda s, d: portfolio.simulate(long_series(s, d), _scenarios(s)).groupBy("scenario").agg(F.round(F.max_by("value", "day"), 2).alias("final"), F.round(F.max_by("gross", "day"), 2).alias("final_gross"), F.round(F.sum("cost"), 2).alias("cost"), F.sum("orders").alias("orders"))
)
R.add("sim12_bootstrap")(lambda s, d: portfolio.bootstrap(_ret(s, d).where("symbol = '1-URGENT'")))
R.add("sim11_walk_forward", with_views("long", _AL + f""", v as (select day, sum(w0 / 10 * close / f) as v, row_number() over (order by day) - 1 as i from (select *, first_value(close) over (partition by symbol order by day) as f from al) join {_WV} using (symbol) group by 1),
    n as (select *, count(*) over () c from v) select k as window_id, min(day) as start, max(day) as "end", round(arg_max(v, day) / arg_min(v, day) - 1, 6) as total_return, count(*) as "rows"
    from n join (select unnest(generate_series(0, 100)) k) on i between k * 126 and k * 126 + 251 where k * 126 + 252 <= c group by 1"""))(
    lambda s, d: walk_forward(portfolio.buy_and_hold(_aligned(s, d), _weights(s), 1.0).select(F.lit("p").alias("symbol"), "day", F.col("value").alias("close")), 252, 126)
    .select("window_id", "start", "end", *r(6, "total_return"), "rows")
)
_M = """, c as (select symbol, day, ret, exp(sum(ln(1 + ret)) over (partition by symbol order by day rows unbounded preceding)) as c from r),
 dd as (select *, c / greatest(1, max(c) over (partition by symbol order by day rows unbounded preceding)) - 1 as dd from c), q as (select symbol, quantile_cont(ret, 0.05) q5 from r group by 1)
 select symbol, count(*) n, round(exp(sum(ln(1 + ret)) * 252 / count(*)) - 1, 6) as cagr, round(stddev_samp(ret) * sqrt(252), 6) as volatility, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) as sharpe,
 round(avg(ret) / sqrt(avg(case when ret < 0 then ret * ret else 0 end)) * sqrt(252), 6) as sortino, round(min(dd), 6) as max_drawdown, round(avg((ret > 0)::int), 6) as win_rate, round(max(ret), 6) best, round(min(ret), 6) worst,
 round(max(q5), 6) as var_95, round(avg(case when ret <= q5 then ret end), 6) as cvar_95, round(sqrt(avg(dd * dd)), 6) as ulcer, round(quantile_cont(ret, 0.95) / abs(quantile_cont(ret, 0.05)), 6) as tail_ratio,
 round(skewness(ret), 6) as skew, round(kurtosis(ret), 6) as kurtosis, round((exp(sum(ln(1 + ret)) * 252 / count(*)) - 1) / -min(dd), 6) as calmar from dd join q using (symbol) group by 1"""
_MC = ("cagr", "volatility", "sharpe", "sortino", "max_drawdown", "win_rate", "best", "worst", "var_95", "cvar_95", "ulcer", "tail_ratio", "skew", "kurtosis", "calmar")
R.add("pf3_metrics", with_views("long", _RET + _M))(lambda s, d: portfolio.metrics(_ret(s, d)).select("symbol", "n", *r(6, *_MC)))
R.add("pf13_benchmark_metrics", with_views("long", _RET + _BEN + """ select symbol, count(*) n, round(covar_samp(ret, b) / var_samp(b), 6) as beta, round((avg(ret) - covar_samp(ret, b) / var_samp(b) * avg(b)) * 252, 6) as alpha, round(corr(ret, b), 6) as corr,
    round(stddev_samp(ret - b) * sqrt(252), 6) as tracking_error, round(avg(ret - b) / stddev_samp(ret - b) * sqrt(252), 6) as information_ratio from r join b using (day) group by 1"""))(
    lambda s, d: portfolio.benchmark(_ret(s, d), _bench(s, d)).select("symbol", "n", *r(6, "beta", "alpha", "corr", "tracking_error", "information_ratio"))
)
R.add("pf4_attribution", with_views("long", _AL + f""", r as (select * from (select symbol, day, close / lag(close) over (partition by symbol order by day) - 1 as ret from al) where ret is not null), b as (select day, avg(ret) as b from r group by 1),
    g as (select *, exp(sum(ln(1 + ret)) over (partition by symbol order by day rows unbounded preceding)) as g from r), v as (select g.*, w0 / 10 * coalesce(lag(g) over (partition by symbol order by day), 1) as v from g join {_WV} using (symbol)),
    s as (select *, v / sum(v) over (partition by day) as w from v) select symbol, round(sum(w * ret), 5) as contribution, round(sum(w * b), 5) as allocation, round(sum(w * (ret - b)), 5) as selection from s join b using (day) group by 1"""))(
    lambda s, d: portfolio.attribution(returns(_aligned(s, d)), _weights(s), returns(_aligned(s, d)).groupBy("day").agg(F.avg("ret").alias("ret"))).select("symbol", *r(5, "contribution", "allocation", "selection"))
)
R.add("pf5_clusters")(lambda s, d: portfolio.clusters(align.correlated_pairs(returns(_priced(_dl(s, d))), 0.6), _dl(s, d).select("symbol").distinct()))


def _dl(s, d):
    """Daily closes of every listing, as series keyed symbol/exchange."""
    return daily(s, d).select(F.concat("symbol", F.lit("/"), "exchange").alias("symbol"), "day", "close")


def _priced(dl):
    """Days with a finite positive close: from any other no return can be taken."""
    return dl.where("close > 0 and close < double('inf')")


R.add("pf11_inverse_volatility", with_views("long", _RET + """, l as (select * from (select *, row_number() over (partition by symbol order by day desc) n from r) where n <= 60), v as (select symbol, 1 / stddev_samp(ret) as i, case when symbol < '3' then 'a' else 'b' end as cluster from l group by symbol)
    select symbol, cluster, round(i / sum(i) over (partition by cluster) / 2, 8) as weight from v"""))(
    lambda s, d: portfolio.inverse_volatility(_ret(s, d), long_series(s, d).select("symbol").distinct().withColumn("cluster", F.when(F.col("symbol") < "3", "a").otherwise("b"))).select("symbol", "cluster", *r(8, "weight"))
)
R.add("pf12_restrict", f"select symbol, round(w0 / 7, 8) as weight from {_WV} where symbol in ('1-URGENT', '2-HIGH', '3-MEDIUM')")(
    lambda s, d: portfolio.restrict_weights(_weights(s), s.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",)], "symbol string")).select("symbol", *r(8, "weight"))
)
R.add("pf10_drift", with_views("legs", f", c as (select strategy, symbol, sum(qty) q from legs group by 1, 2), a as (select symbol, q / sum(q) over () as w from c where strategy = 'O'), b as (select symbol, q / sum(q) over () as t from c where strategy = 'F') select round(max(abs(coalesce(w, 0) - coalesce(t, 0))), 8) as drift, max(abs(coalesce(w, 0) - coalesce(t, 0))) > 0.001 as rebalance from a full join b on a.symbol = b.symbol"))(
    lambda s, d: portfolio.drift_test(*[portfolio.normalise_weights(legs(s, d).where(F.col("strategy") == x).groupBy("symbol").agg(F.sum("qty").alias("weight"))) for x in ("O", "F")], 0.001).select(*r(8, "drift"), "rebalance")
)
_WMA = lambda c, n: "(" + " + ".join(f"{n - k} * lag({c}, {k}) over (partition by symbol order by day)" for k in range(n)) + f") / {n * (n + 1) / 2}"
R.add("pf14_sector_rotation", with_views("long", f""", bb as (select day, avg(close) as b from long group by 1), s as (select symbol, day, 100 * close / b as rs from long join bb using (day)), t as (select *, 100 * ({_WMA('rs', 14)}) / ({_WMA('rs', 36)}) as ratio from s),
    m as (select *, 100 * ratio / lag(ratio, 8) over (partition by symbol order by day) as momentum from t)
    select symbol, day, round(ratio, 6) as ratio, round(momentum, 6) as momentum, case when ratio >= 100 and momentum >= 100 then 'leading' when ratio >= 100 then 'weakening' when momentum >= 100 then 'improving' else 'lagging' end as quadrant from m where momentum is not null"""))(
    lambda s, d: portfolio.rotation(long_series(s, d), long_series(s, d).groupBy("day").agg(F.avg("close").alias("close"))).select("symbol", "day", *r(6, "ratio", "momentum"), "quadrant")
)
_PF6 = """, m as (select symbol, avg(ret) * 252 as ret, stddev_samp(ret) * sqrt(252) as vol from r group by 1), s as (select symbol, greatest(0, least(100, (ret - (-1.0)) / (5.0 - (-1.0)) * 100)) as a, greatest(0, least(100, (vol - 12.0) / (4.0 - 12.0) * 100)) as b from m)
  select symbol, round((a * 2 + b) / 3, 4) as score, case when (a * 2 + b) / 3 >= 80 then 'A' when (a * 2 + b) / 3 >= 65 then 'B' when (a * 2 + b) / 3 >= 50 then 'C' when (a * 2 + b) / 3 >= 35 then 'D' else 'F' end as grade from s"""
_hv = lambda s, d: _ret(s, d).groupBy("symbol").agg((F.avg("ret") * 252).alias("ret"), (F.stddev_samp("ret") * 252**0.5).alias("vol"))
R.add("pf6_health", with_views("long", _RET + _PF6))(lambda s, d: portfolio.health(_hv(s, d), {"ret": (-1.0, 5.0, 2.0), "vol": (12.0, 4.0, 1.0)}).select("symbol", *r(4, "score"), "grade"))
R.add("pf7_findings", with_views("long", _RET + ", m as (select symbol, avg(ret) * 252 as ret, stddev_samp(ret) * sqrt(252) as vol from r group by 1) select symbol, 'volatile' as finding from m where vol > 5 union all select symbol, 'rising' from m where ret > 0"))(
    lambda s, d: portfolio.findings(_hv(s, d), [("volatile", "vol > 5"), ("rising", "ret > 0")])
)
R.add("pf8_crisis_table", with_views("long", """, c(name, a, z) as (values ('c1', date '1996-01-10', date '1996-06-30'), ('c2', date '1998-03-01', date '1998-09-15'))
    select name, symbol, round(arg_max(close, day) / arg_min(close, day) - 1, 6) as move, round(min(close) / arg_min(close, day) - 1, 6) as worst, count(*) n from long join c on day between a and z group by 1, 2"""))(
    lambda s, d: align.range_join(long_series(s, d).withColumn("u", F.unix_date("day")), s.createDataFrame([("c1", "1996-01-10", "1996-06-30"), ("c2", "1998-03-01", "1998-09-15")], "name string, a string, z string").select("name", F.unix_date(F.to_date("a")).alias("lo"), F.unix_date(F.to_date("z")).alias("hi")), "u", "lo", "hi", 128)
    .groupBy("name", "symbol").agg(F.round(F.max_by("close", "day") / F.min_by("close", "day") - 1, 6).alias("move"), F.round(F.min("close") / F.min_by("close", "day") - 1, 6).alias("worst"), F.count("*").alias("n"))
)
R.add("pf9_holdings_parse", "select p_partkey::varchar as symbol, p_size::double as qty, round(coalesce(case when p_partkey % 3 <> 0 then p_retailprice end, p_retailprice - 5 + 5.0 * p_size / p_size), 6) as ltp from part where p_size > 0")(
    lambda s, d: books.parse_holdings(
        table(s, d, "part").where("p_size > 0").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_size").cast("string").alias("qty"), (F.col("p_retailprice") - 5).cast("string").alias("price"), (F.col("p_size") * 5).cast("string").alias("pnl"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("ltp"))
    ).select("symbol", "qty", *r(6, "ltp"))
)

# ---- periodic investment
_SPAN = ", sp as (select symbol, min(day) as lo, max(day) as hi from long group by 1)"
_REQ = _SPAN + ", q as (select symbol, row_number() over (partition by symbol order by day) - 1 as n, day from (select symbol, unnest(generate_series(date_trunc('month', lo)::date + 4, hi, interval 1 month))::date as day, lo from sp) where day >= lo)"
_SCH = _REQ + ", sc as (select * from (select q.*, (select min(day) from long l where l.symbol = q.symbol and l.day >= q.day) as session from q) where session is not null)"


def _span(s, d):
    return long_series(s, d).groupBy("symbol").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))


def _schedule(s, d):
    return sip.schedule(_span(s, d), long_series(s, d), "monthly", 5)


R.add("sp1_schedule", with_views("long", _SCH + " select symbol, cast(n as int) as n, day as requested, session from sc"))(lambda s, d: _schedule(s, d))
R.add("sp1_fortnightly", with_views("long", _SPAN + " select symbol, unnest(generate_series(lo, hi, interval 14 day))::date as day from sp"))(lambda s, d: sip.requested_dates(_span(s, d), "fortnightly").select("symbol", "day"))
R.add("sp2_step_up", with_views("long", _SCH + ", f as (select *, min(session) over (partition by symbol) as s0 from sc) select symbol, session, round(1000 * power(1.1, (session - s0) // 365), 4) as amount from f"))(
    lambda s, d: _schedule(s, d).withColumn("s0", F.min("session").over(Window.partitionBy("symbol"))).select("symbol", "session", F.round(sip.step_up(1000.0, 0.1, F.col("session"), F.col("s0")), 4).alias("amount"))
)


def _installments(s, d, amount=1_000_000.0):
    return _schedule(s, d).join(long_series(s, d).withColumnRenamed("day", "session"), ["symbol", "session"]).withColumn("amount", F.lit(amount))


_INS = _SCH + ", i as (select sc.symbol, sc.session, sc.n, l.close, 1000000.0::double as amount from sc join long l on l.symbol = sc.symbol and l.day = sc.session)"
_PLAN = """, o as (select *, row_number() over (partition by symbol order by session, n) as k from i),
  p as (select symbol, k, amount - floor(amount / close) * close as cash, floor(amount / close) as units, amount as invested from o where k = 1
    union all select o.symbol, o.k, (p.cash + o.amount) - floor((p.cash + o.amount) / o.close) * o.close, p.units + floor((p.cash + o.amount) / o.close), p.invested + o.amount from p join o on o.symbol = p.symbol and o.k = p.k + 1)"""
_rec = lambda sql: sql.replace("with long", "with recursive long", 1)
R.add("sim3_sip_units", _rec(with_views("long", _INS + _PLAN + " select symbol, cast(max(k) as int) as installments, arg_max(units, k) as units, round(arg_max(cash, k), 2) as cash, max(invested) as invested from p group by 1")))(
    lambda s, d: sip.run_plan(_installments(s, d)).select("symbol", "installments", "units", *r(2, "cash"), "invested")
)
R.add("sp4_headline", _rec(with_views("long", _INS + _PLAN + """, e as (select symbol, arg_max(close, day) as price from long group by 1), t as (select symbol, max(k) as installments, arg_max(units, k) as units, arg_max(cash, k) as cash, max(invested) as invested from p group by 1)
    select symbol, cast(installments as int) installments, round((units * price + cash) / invested, 6) as multiple, round((invested - cash) / units, 4) as average_cost from t join e using (symbol)""")))(
    lambda s, d: sip.headline(sip.run_plan(_installments(s, d)), long_series(s, d).groupBy("symbol").agg(F.max_by("close", "day").alias("close"))).select("symbol", "installments", *r(6, "multiple"), *r(4, "average_cost"))
)
R.add("sim4_lump_sum", with_views("long", ", e as (select symbol, arg_min(close, day) as p0, arg_max(close, day) as p1 from long group by 1) select symbol, floor(5000000 / p0) as units, round(floor(5000000 / p0) * p1 + (5000000 - floor(5000000 / p0) * p0), 3) as value from e"))(
    lambda s, d: sip.lump_sum(long_series(s, d).groupBy("symbol").agg(F.min_by("close", "day").alias("close")), long_series(s, d).groupBy("symbol").agg(F.max_by("close", "day").alias("close")), 5_000_000.0).select("symbol", "units", *r(3, "value"))
)
_FLOW = _INS + """, f as (select symbol, session as day, -amount as a from i union all select i.symbol, e.day, sum(i.amount / i.close) * e.price from i join (select symbol, max(day) as day, arg_max(close, day) as price from long group by 1) e on e.symbol = i.symbol group by i.symbol, e.day, e.price),
  ff as (select symbol, day, sum(a) as a, min(day) over (partition by symbol) as d0 from f group by 1, 2),
  bs as (select distinct symbol, -0.9::double as lo, 10.0::double as hi, 0 as k from ff union all
    select bs.symbol, case when s.v > 0 then (lo + hi) / 2 else lo end, case when s.v > 0 then hi else (lo + hi) / 2 end, k + 1 from bs, lateral (select sum(a / power(1 + (lo + hi) / 2, (day - d0) / 365.0)) as v from ff where ff.symbol = bs.symbol) s where k < 60)"""
R.add("sim16_xirr", _rec(with_views("long", _FLOW + " select symbol, round((lo + hi) / 2, 6) as xirr from bs where k = 60")))(
    lambda s, d: sip.xirr(
        _installments(s, d).select("symbol", F.col("session").alias("day"), (-F.col("amount")).alias("amount")).unionByName(
            _installments(s, d).groupBy("symbol").agg(F.sum(F.col("amount") / F.col("close")).alias("u")).join(long_series(s, d).groupBy("symbol").agg(F.max("day").alias("day"), F.max_by("close", "day").alias("p")), "symbol").select("symbol", "day", (F.col("u") * F.col("p")).alias("amount")))
    ).select("symbol", *r(6, "xirr"))
)
R.add("sp6_rolling_plans", with_views("long", """, m as (select symbol, cast(date_trunc('month', day) as date) mo, arg_min(close, day) buy, arg_max(close, day) fin from long group by 1, 2), x as (select *, (year(mo) - 1970) * 12 + month(mo) - 1 as i from m),
    s as (select x.symbol, x.i as s, n, x.mo from x join (select symbol, min(i) lo from x group by 1) l using (symbol), (values (12), (36)) y(n) where (x.i - lo) % 3 = 0)
    select s.symbol, s.mo as start, cast(n // 12 as int) as years, round(sum(1000 / buy) * arg_max(fin, x.i) / (n * 1000), 6) as multiple from s join x on x.symbol = s.symbol and x.i between s.s and s.s + n - 1 group by s.symbol, s.mo, n having count(*) = n"""))(
    lambda s, d: sip.rolling_plans(long_series(s, d), [1, 3], 3, 1000.0).select("symbol", "start", "years", *r(6, "multiple"))
)
R.add("sp10_yearly", with_views("long", _INS + " select symbol, cast(year(session) as int) as year, sum(amount) as invested, round(sum(amount / close), 6) as units from i group by 1, 2"))(
    lambda s, d: _installments(s, d).groupBy("symbol", F.year("session").alias("year")).agg(F.sum("amount").alias("invested"), F.round(F.sum(F.col("amount") / F.col("close")), 6).alias("units"))
)
R.add("sp8_day_of_month", with_views("long", _SPAN + """, q as (select symbol, dom, unnest(generate_series(date_trunc('month', lo)::date + dom - 1, hi, interval 1 month))::date as day, lo from sp, (values (1), (10), (20), (28)) v(dom)),
    t as (select dom, symbol, (select min(day) from long l where l.symbol = q.symbol and l.day >= q.day) as session from q where day >= lo), e as (select symbol, arg_max(close, day) price from long group by 1)
    select dom, t.symbol, count(*) n, round(sum(1000 / close) * max(price) / (1000 * count(*)), 6) as multiple from t join long l on l.symbol = t.symbol and l.day = session join e on e.symbol = t.symbol group by 1, 2"""))(
    lambda s, d: _by_day(s, d)
)


def _by_day(s, d):
    out = None
    last = long_series(s, d).groupBy("symbol").agg(F.max_by("close", "day").alias("price"))
    for dom in (1, 10, 20, 28):
        x = sip.schedule(_span(s, d), long_series(s, d), "monthly", dom).join(long_series(s, d).withColumnRenamed("day", "session"), ["symbol", "session"]).join(last, "symbol")
        x = x.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum(1000 / F.col("close")) * F.max("price") / (F.count("*") * 1000), 6).alias("multiple")).select(F.lit(dom).alias("dom"), "symbol", "n", "multiple")
        out = x if out is None else out.unionByName(x)
    return out


# ---- research
_F = "over (partition by symbol order by day rows between {} preceding and current row)"
_FEAT = f""", a as (select symbol, day, close, close / lag(close) over (partition by symbol order by day) - 1 as r, abs(close - lag(close) over (partition by symbol order by day)) as m from long),
  f as (select symbol, day, close, count(close) {_F.format(59)} as k, avg(close) {_F.format(19)} as sma20, avg(close) {_F.format(59)} as sma60, close / lag(close, 20) over (partition by symbol order by day) - 1 as momentum, stddev_samp(r) {_F.format(19)} * sqrt(252) as volatility,
    abs(close - lag(close, 20) over (partition by symbol order by day)) / nullif(sum(m) {_F.format(19)}, 0) as efficiency, greatest(0, 1 - close / max(close) {_F.format(59)}) as drawdown from a),
  g as (select symbol, day, close, case when k = 60 then sma20 end sma20, case when k = 60 then sma60 end sma60, case when k = 60 then momentum end momentum, case when k = 60 then volatility end volatility, case when k = 60 then efficiency end efficiency, case when k = 60 then drawdown end drawdown from f)"""
_FC = ("sma20", "sma60", "momentum", "volatility", "efficiency", "drawdown")
R.add("rs1_regime_features", with_views("long", _FEAT + " select symbol, day, " + ", ".join(f"round({c}, 5) as {c}" for c in _FC) + " from g"))(lambda s, d: research.regime_features(long_series(s, d)).select("symbol", "day", *r(5, *_FC)))
_P = lambda c: f"lag({c}) over (partition by symbol order by day)"
_MR = lambda c: f"(count(*) filter (where y.{c} < x.{c} - (1e-12 + 1e-9 * abs(x.{c}))) + 0.5 * count(*) filter (where abs(y.{c} - x.{c}) <= 1e-12 + 1e-9 * abs(x.{c}))) * 100.0 / 90"
R.add("rs2_regimes", with_views("long", _FEAT + f""", n as (select *, row_number() over (partition by symbol order by day) rn from g where volatility is not null),
    v as (select x.symbol, x.day, case when count(y.rn) = 90 then {_MR('volatility')} end as vr, case when count(y.rn) = 90 then {_MR('drawdown')} end as dr
      from n x left join n y on x.symbol = y.symbol and y.rn between x.rn - 90 and x.rn - 1 group by 1, 2),
    h as (select g.symbol, g.day, {_P('vr')} as vr, {_P('dr')} as dr, {_P('efficiency')} as e, ({_P('sma20')} / {_P('sma60')} - 1) * 100 as gap, {_P('momentum')} * 100 as m, {_P('drawdown')} * 100 as dd
      from (select g.*, vr, dr from g left join v on g.symbol = v.symbol and g.day = v.day) g)
    select symbol, day, case when vr is null then 'unknown' when e <= 0.2 then 'range' when e >= 0.3 and gap >= 0.5 and m >= 1 then 'up' when e >= 0.3 and gap <= -0.5 and m <= -1 then 'down' else 'unknown' end as trend,
      case when vr is null then 'unknown' when vr >= 90 then 'high' else 'normal' end as vol_class,
      case when vr is null then 'unknown' when vr >= 90 and dd >= 5 and dr >= 90 then 'elevated' else 'normal' end as stress from h"""))(lambda s, d: research.regimes(research.regime_features(long_series(s, d))))  # fmt: skip
R.add("rs4_relative_strength", with_views("long", """, b as (select day, avg(close) as b from long group by 1), j as (select symbol, day, close as s, b from long join b using (day)),
    k as (select *, count(*) over (partition by symbol order by day rows between 120 preceding and current row) as k, 100 * ((s / lag(s, 120) over w) / (b / lag(b, 120) over w) - 1) as rs from j window w as (partition by symbol order by day)) select symbol, day, round(case when k = 121 then rs end, 5) as rs from k"""))(
    lambda s, d: research.relative_strength(long_series(s, d), long_series(s, d).groupBy("day").agg(F.avg("close").alias("close")), 120).select("symbol", "day", *r(5, "rs"))
)
R.add("rs5_unknown_dominates", "select id, case when filled_quantity is null or trigger_price is null then null else filled_quantity > 0 and trigger_price > 100 end as pass from sandbox_orders")(
    lambda s, d: table(s, d, "sandbox_orders").select("id", research.unknown_and(F.col("filled_quantity") > 0, F.col("trigger_price") > 100).alias("pass"))
)
_ACT = [("1-URGENT", "1996-05-01", 0.5), ("1-URGENT", "1998-02-02", 0.8), ("5-LOW", "1997-07-07", 2.0), ("5-LOW", "2030-01-01", 9.0)]
R.add("rs7_corporate_actions", with_views("long", """, a(symbol, ex, f) as (values ('1-URGENT', date '1996-05-01', 0.5::double), ('1-URGENT', date '1998-02-02', 0.8::double), ('5-LOW', date '1997-07-07', 2.0::double))
    select l.symbol, l.day, round(l.close * exp(coalesce(sum(ln(f)), 0)), 4) as adjusted from long l left join a on a.symbol = l.symbol and l.day < a.ex group by l.symbol, l.day, l.close"""))(
    lambda s, d: research.adjust(long_series(s, d), s.createDataFrame(_ACT, "symbol string, ex string, factor double").select("symbol", F.to_date("ex").alias("ex_date"), "factor"), F.lit("2005-01-01").cast("date")).select("symbol", "day", *r(4, "adjusted"))
)
R.add("rs8_warmup", with_views("long", """, n as (select *, row_number() over (partition by symbol order by day) n from long), a as (select symbol, min(n) a from n where day >= date '1997-01-01' group by 1) select symbol, day, round(close, 4) as close from n join a using (symbol) where n >= a - 60"""))(
    lambda s, d: research.with_warmup(long_series(s, d), F.lit("1997-01-01").cast("date"), 60).select("symbol", "day", *r(4, "close"))
)
_CNT = ", c as (select symbol, cast(make_timestamp(us) as date) as day, count(*) n from ticks group by 1, 2)"
R.add("rs10_signal_modes", with_views("ticks", _CNT + " select symbol, day, n, case when count(n) over w = 7 then n < avg(n) over w / 2 end as trough, n = 0 as zero, n > lag(n) over (partition by symbol order by day) as uptick from c window w as (partition by symbol order by day rows between 7 preceding and 1 preceding)"))(
    lambda s, d: research.signal_modes(ticks(s, d).groupBy("symbol", F.to_date(F.timestamp_micros("us")).alias("day")).agg(F.count("*").alias("n")))
)
R.add("rs12_required_ranges", with_views("daily", """, s as (select symbol, day - 10 as lo, day + 5 as hi from daily where volume > 100000), t as (select *, max(hi) over (partition by symbol order by lo, hi rows between unbounded preceding and 1 preceding) as top from s),
    g as (select *, sum(case when top is null or lo > top + 1 then 1 else 0 end) over (partition by symbol order by lo, hi rows unbounded preceding) as g from t) select symbol, min(lo) as lo, max(hi) as hi, count(*) as signals from g group by symbol, g"""))(
    lambda s, d: research.required_ranges(daily(s, d).where("volume > 100000").select("symbol", "day"), 10, 5)
)
R.add("rs13_complete_signals", with_views("daily", ", x as (select distinct symbol, day from daily where volume > 100000), m as (select distinct symbol, day from daily where exchange = 'BSE') select count(*) as kept from x where not exists (select 1 from m where m.symbol = x.symbol and m.day = x.day)"))(
    lambda s, d: research.complete_only(daily(s, d).where("volume > 100000").select("symbol", "day").distinct(), daily(s, d).where("exchange = 'BSE'").select("symbol", "day")).agg(F.count("*").alias("kept"))
)
R.add("rs14_identity", "select distinct id, sha256('{\"exchange\":\"' || exchange || '\",\"id\":' || id || ',\"status\":\"' || status || '\"}') as identity from job_items where exchange is not null and status is not null")(
    lambda s, d: table(s, d, "job_items").where("exchange is not null and status is not null").select("id", research.identity(table(s, d, "job_items"), "id", "exchange", "status").alias("identity")).distinct()
)
R.add("rs15_deltas", with_views("long", _RET + ", m as (select symbol, avg(ret) a, stddev_samp(ret) b from r group by 1) select symbol, round(a - (select a from m where symbol = '5-LOW'), 8) as d_mean, round(b - (select b from m where symbol = '5-LOW'), 8) as d_sd from m"))(
    lambda s, d: _ret(s, d).groupBy("symbol").agg(F.avg("ret").alias("a"), F.stddev_samp("ret").alias("b")).select("symbol",
        F.round(F.col("a") - _ret(s, d).where("symbol = '5-LOW'").agg(F.avg("ret")).scalar(), 8).alias("d_mean"), F.round(F.col("b") - _ret(s, d).where("symbol = '5-LOW'").agg(F.stddev_samp("ret")).scalar(), 8).alias("d_sd"))
)
R.add("rs16_frontier", "select p_partkey, p_size, p_retailprice from part a where not exists (select 1 from part b where b.p_size >= a.p_size and b.p_retailprice >= a.p_retailprice and (b.p_size > a.p_size or b.p_retailprice > a.p_retailprice))")(
    lambda s, d: research.frontier(table(s, d, "part"), "p_partkey", "p_size", "p_retailprice")
)
R.add("rs17_origins", "select symbol, string_agg(distinct exchange, ',' order by exchange) as origins, count(*) n from symtoken group by 1")(lambda s, d: research.union_frontier(table(s, d, "symtoken"), ["symbol"], "exchange"))
R.add("rs18_half_masks", with_views("long", ", h as (select symbol, (row_number() over (order by sha256(symbol)) - 1) % 2 as half from (select distinct symbol from long)) select half, year(day) % 2 = 0 as even, count(*) n, round(avg(close), 3) as mean from long join h using (symbol) group by 1, 2"))(
    lambda s, d: long_series(s, d).join(long_series(s, d).select("symbol").distinct().select("symbol", ((F.row_number().over(Window.orderBy(F.sha2("symbol", 256))) - 1) % 2).alias("half")), "symbol")
    .groupBy("half", (F.year("day") % 2 == 0).alias("even")).agg(F.count("*").alias("n"), F.round(F.avg("close"), 3).alias("mean"))
)
R.add("rs19_repetition", "select sha256(concat_ws('|', l_partkey::varchar, l_suppkey::varchar, l_returnflag)) as fingerprint, count(*) n from lineitem group by 1 having count(*) > 1")(
    lambda s, d: research.repetition(table(s, d, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag"])
)
R.add("rs20_suitability", with_views("long", _RET + ", q as (select symbol, day, ret, case when lag(ret) over (partition by symbol order by day) > 0 then 'after_up' else 'after_down' end as state from r) select symbol, state, count(*) n, round(avg(ret), 7) as mean, round(avg((ret > 0)::int), 6) as win_rate from q group by 1, 2"))(
    lambda s, d: _ret(s, d).withColumn("state", F.when(F.lag("ret").over(by()) > 0, "after_up").otherwise("after_down")).groupBy("symbol", "state").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 7).alias("mean"), F.round(F.avg((F.col("ret") > 0).cast("int")), 6).alias("win_rate"))
)
_SIG = "select symbol, day from daily where exchange = 'NSE' and volume > 100000"
R.add("sim6_first_exit", with_views("daily", f""", b as (select *, row_number() over (partition by symbol order by day) as i from daily where exchange = 'NSE'), s as (select b.symbol, b.day as signal_day, b.i as i0 from b where volume > 100000),
    j as (select s.symbol, s.signal_day, s.i0, b.* exclude (symbol), first_value(b.open) over (partition by s.symbol, s.signal_day order by b.i) as entry from s join b on b.symbol = s.symbol and b.i between s.i0 + 1 and s.i0 + 5),
    x as (select *, case when low <= entry * 0.97 then least(open, entry * 0.97) when high >= entry * 1.05 then greatest(open, entry * 1.05) when i = i0 + 5 then close end as exit,
      case when low <= entry * 0.97 then 'stop' when high >= entry * 1.05 then 'target' when i = i0 + 5 then 'time' end as why from j)
    select symbol, signal_day, arg_min(day, i) as exit_day, round(arg_min(entry, i), 4) as entry, round(arg_min(exit, i), 6) as exit, arg_min(why, i) as why from x where exit is not null group by 1, 2"""))(
    lambda s, d: research.first_exit(daily(s, d).where("exchange = 'NSE' and volume > 100000").select("symbol", "day"), daily(s, d).where("exchange = 'NSE'").select("symbol", "day", "open", "high", "low", "close"), 0.03, 0.05, 5)
    .select("symbol", "signal_day", "exit_day", *r(4, "entry"), *r(6, "exit"), "why")
)
R.add("r12_last_close", with_views("daily", "select symbol || '/' || exchange as symbol, cast(date_trunc('month', day) as date) as period, max(day) last_day, arg_max(close, day) as last_value from daily group by 1, 2"))(
    lambda s, d: last_of_period(daily(s, d).withColumn("symbol", F.concat("symbol", F.lit("/"), "exchange")), F.trunc("day", "month"))
)
