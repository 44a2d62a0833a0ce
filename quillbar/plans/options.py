"""Queries of option analytics and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbar.functions import mathx
from quillbar.functions.intervals import parse_interval
from quillbar.operators import options
from quillbar.plans import Registry
from quillbar.sources.tables import table
from quillbar.sources.views import bars, chain, daily, long_series, with_views

R = Registry()
_SPOT = 125.0


def _greeked(s, d):
    k = F.col("strike")
    return chain(s, d).withColumn("gamma", F.when(k % 5 != 0, F.lit(0.01) / (1 + F.abs(k - _SPOT)))).withColumn("delta", F.lit(1.0) / (1 + F.exp((k - _SPOT) / 10)) - F.when(F.col("side") == "CE", 0.0).otherwise(1.0))


_G = ", g as (select *, case when strike % 5 <> 0 then 0.01::double / (1 + abs(strike - 125)) end as gamma, 1.0::double / (1 + exp((strike - 125) / 10)) - case when side = 'CE' then 0 else 1 end as delta from chain)"


def _vol(s, d):
    return chain(s, d).withColumn("iv", F.when(F.col("strike") % 4 != 0, F.lit(0.2) + F.abs(F.col("strike") - _SPOT) / 200 + F.when(F.col("side") == "PE", 0.01).otherwise(0.0)))


_V = ", v as (select *, case when strike % 4 <> 0 then 0.2::double + abs(strike - 125) / 200 + case when side = 'PE' then 0.01 else 0 end end as iv from chain)"
_WIDE = ", w as (select expiry, strike, max(oi) filter (where side = 'CE') ce_oi, max(oi) filter (where side = 'PE') pe_oi, max(ltp) filter (where side = 'CE') ce_ltp, max(ltp) filter (where side = 'PE') pe_ltp from chain group by 1, 2)"

R.add("o7_atm_strike", "select p_partkey, floor(p_retailprice / 50 + 0.5) * 50 as atm from part")(
    lambda s, d: table(s, d, "part").select("p_partkey", options.atm_strike(F.col("p_retailprice"), F.lit(50.0)).cast("double").alias("atm"))
)
R.add("o8_oi_totals", with_views("chain", """, t as (select expiry, sum(oi) filter (where side = 'CE') ce_oi, sum(volume) filter (where side = 'CE') ce_volume, sum(oi) filter (where side = 'PE') pe_oi, sum(volume) filter (where side = 'PE') pe_volume from chain group by 1)
    select *, round(coalesce(pe_oi / nullif(ce_oi, 0), 0), 2) as pcr_oi, round(coalesce(pe_volume / nullif(ce_volume, 0), 0), 2) as pcr_volume from t"""))(lambda s, d: options.totals(chain(s, d)))  # fmt: skip
_PAIN = _WIDE + """, p as (select a.expiry, a.strike, sum(case when b.strike < a.strike then (a.strike - b.strike) * coalesce(b.ce_oi, 0) else 0 end + case when b.strike > a.strike then (b.strike - a.strike) * coalesce(b.pe_oi, 0) else 0 end) as pain
    from w a join w b on a.expiry = b.expiry group by 1, 2)"""
R.add("o9_pain_by_strike", with_views("chain", _PAIN + " select * from p"))(lambda s, d: options.pain(chain(s, d)))
R.add("j12_max_pain", with_views("chain", _PAIN + " select expiry, arg_min(strike, (pain, strike)) as max_pain, min(pain) as pain from p group by 1"))(lambda s, d: options.max_pain(chain(s, d)))
_PROF = _G + """, e as (select *, case when side = 'CE' then 1 else -1 end * coalesce(gamma, 0) * oi * 125.0::double * 125.0::double * 0.01 / 1e7 as gex, delta * oi * 125.0::double / 1e7 as dex from g),
    p as (select expiry, strike, sum(gex) filter (where side = 'CE') as ce_gex, sum(gex) filter (where side = 'PE') as pe_gex, sum(gex) as gex, sum(dex) as dex, bool_or(gamma is null and oi > 0) as unpriced from e group by 1, 2)"""
R.add("o11_strike_profile", with_views("chain", _PROF + " select expiry, strike, round(ce_gex, 15) ce_gex, round(pe_gex, 15) pe_gex, round(gex, 15) gex, round(dex, 10) dex, unpriced from p"))(
    lambda s, d: options.exposure(_greeked(s, d), _SPOT).select("expiry", "strike", *[F.round(c, 15).alias(c) for c in ("ce_gex", "pe_gex", "gex")], F.round("dex", 10).alias("dex"), "unpriced")
)
R.add("o10_walls", with_views("chain", _PROF + " select expiry, arg_max(strike, (coalesce(ce_gex, 0), -strike)) as call_wall, arg_min(strike, (coalesce(pe_gex, 0), strike)) as put_wall, round(sum(gex), 10) as net_gex from p group by 1"))(
    lambda s, d: options.walls(options.exposure(_greeked(s, d), _SPOT)).withColumn("net_gex", F.round("net_gex", 10))
)
R.add("o23_peaks", with_views("chain", _PROF + " select expiry, strike, round(gex, 10) as gex from (select *, max(abs(gex)) over (partition by expiry) as t from p) where abs(gex) >= 0.2 * t"))(
    lambda s, d: options.peaks(options.exposure(_greeked(s, d), _SPOT)).select("expiry", "strike", F.round("gex", 10).alias("gex"))
)
# the twin integrates the density by Simpson's rule
_CDF = "(0.5 + (select sum((case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-power({x} * i / 400, 2) / 2)) from range(401) z(i)) * {x} / 1200 / sqrt(2 * pi()))"
_B = """, b as (select expiry, strike, side, iv, (ln(125.0 / strike) + iv * iv * 0.25 / 2) / (iv * 0.5) as d1, (ln(125.0 / strike) + iv * iv * 0.25 / 2) / (iv * 0.5) - iv * 0.5 as d2 from v where iv is not null)"""
R.add("o1_black76", with_views("chain", _V + _B + f", n as (select *, {_CDF.format(x='d1')} as n1, {_CDF.format(x='d2')} as n2 from b) select expiry, strike, side, round(case when side = 'CE' then 125 * n1 - strike * n2 else strike * (1 - n2) - 125 * (1 - n1) end, 6) as price from n"))(
    lambda s, d: _vol(s, d).where("iv is not null").select("expiry", "strike", "side", F.round(options.black76(F.lit(_SPOT), F.col("strike"), F.lit(0.25), F.col("iv"), F.col("side") == "CE"), 6).alias("price"))
)
R.add("o3_greeks", with_views("chain", _V + _B + f""", n as (select *, {_CDF.format(x='d1')} as n1, {_CDF.format(x='d2')} as n2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) as f1 from b)
    select expiry, strike, side, round(case when side = 'CE' then n1 else n1 - 1 end, 6) as delta, round(f1 / (125 * iv * 0.5), 8) as gamma, round(-125 * f1 * iv / (2 * 0.5) / 365, 8) as theta, round(125 * f1 * 0.5 / 100, 8) as vega,
    round(-0.25 * case when side = 'CE' then 125 * n1 - strike * n2 else strike * (1 - n2) - 125 * (1 - n1) end / 100, 8) as rho from n"""))(
    lambda s, d: options.greeks(_vol(s, d).where("iv is not null").withColumn("f", F.lit(_SPOT)).withColumn("t", F.lit(0.25)), "f", "strike", "t", "iv", F.col("side") == "CE")
    .select("expiry", "strike", "side", F.round("delta", 6).alias("delta"), *[F.round(c, 8).alias(c) for c in ("gamma", "theta", "vega", "rho")])
)
R.add("o4_degenerate_greeks", with_views("chain", "select expiry, strike, side, case when side = 'CE' then case when 125 > strike then 1.0 else 0.0 end else case when 125 < strike then -1.0 else 0.0 end end as delta from chain"))(
    lambda s, d: options.greeks(chain(s, d).withColumn("f", F.lit(_SPOT)).withColumn("t", F.lit(0.0)).withColumn("iv", F.lit(0.2)), "f", "strike", "t", "iv", F.col("side") == "CE").select("expiry", "strike", "side", "delta")
)
# the round trip must return the volatility that made the price
R.add("o2_implied_volatility", with_views("chain", _V + " select expiry, strike, side, round(iv, 5) as iv from v where iv is not null"))(
    lambda s, d: options.implied_volatility(
        _vol(s, d).where("iv is not null").drop("iv", "oi", "volume", "ltp").join(_vol(s, d).select("expiry", "strike", "side", F.col("iv").alias("true")), ["expiry", "strike", "side"])
        .withColumn("f", F.lit(_SPOT)).withColumn("t", F.lit(0.25)).withColumn("call", F.col("side") == "CE")
        .withColumn("x", options.black76(F.col("f"), F.col("strike"), F.col("t"), F.col("true"), F.col("call"))), "f", "strike", "t", "x", "call").select("expiry", "strike", "side", F.round("iv", 5).alias("iv"))
)
R.add("o5_quote_price", "select id, case when price > 0 and trigger_price >= price then (price + trigger_price) / 2 else average_price end as used from (select id, price::double price, trigger_price::double trigger_price, average_price::double average_price from sandbox_orders)")(
    lambda s, d: table(s, d, "sandbox_orders").select("id", options.quote_price(F.col("price").cast("double"), F.col("trigger_price").cast("double"), F.col("average_price").cast("double")).alias("used"))
)
R.add("o6_forward_parity", with_views("chain", _WIDE + " select expiry, arg_min(strike, (abs(ce_ltp - pe_ltp), strike)) as atm, round(arg_min(strike + ce_ltp - pe_ltp, (abs(ce_ltp - pe_ltp), strike)), 6) as forward from w where ce_ltp is not null and pe_ltp is not null group by 1"))(
    lambda s, d: options.forward_from_parity(chain(s, d)).withColumn("forward", F.round("forward", 6))
)
R.add("o12_gamma_density", with_views("chain", _V + """, m as (select expiry, list_sort(list(iv) filter (where iv is not null)) as l from v group by 1), q as (select v.expiry, strike, oi, coalesce(iv, l[cast(len(l) // 2 + 1 as int)]) as s from v join m using (expiry))
    select expiry, strike, round(sum(exp(-power((ln(125.0 / strike) + s * s * 0.1 / 2) / (s * sqrt(0.1)), 2) / 2) / sqrt(2 * pi()) / (125 * s * sqrt(0.1)) * oi), 6) as density from q group by 1, 2"""))(
    lambda s, d: options.gamma_density(_vol(s, d), _SPOT, 0.1).withColumn("density", F.round("density", 6))
)
R.add("o13_smile", with_views("chain", _V + """, n as (select * from v where iv is not null)
    select expiry, round((arg_min(iv, (abs(strike - 125), strike)) filter (where side = 'CE') + arg_min(iv, (abs(strike - 125), strike)) filter (where side = 'PE')) / 2, 6) as atm_iv,
    round(arg_min(iv, (abs(strike - 118.75), strike)) filter (where side = 'PE') - arg_min(iv, (abs(strike - 131.25), strike)) filter (where side = 'CE'), 6) as skew from n group by 1"""))(
    lambda s, d: options.smile(_vol(s, d), _SPOT).select("expiry", F.round("atm_iv", 6).alias("atm_iv"), F.round("skew", 6).alias("skew"))
)
R.add("o14_surface", with_views("chain", _V + """, c as (select strike from v group by 1 having count(distinct expiry) = (select count(distinct expiry) from v))
    select expiry, strike, round(max(iv) filter (where side = case when strike >= 125 then 'CE' else 'PE' end), 6) as iv from v where strike in (select strike from c) group by 1, 2"""))(
    lambda s, d: options.surface(_vol(s, d), _SPOT).withColumn("iv", F.round("iv", 6))
)
R.add("o15_oi_change", with_views("daily", """, r as (select symbol, exchange, oi, row_number() over (partition by symbol, exchange order by day desc) n from daily)
    select symbol, exchange, max(oi) filter (where n = 1) as oi, coalesce(max(oi) filter (where n = 1) - max(oi) filter (where n = 2), 0) as change from r group by 1, 2"""))(
    lambda s, d: options.oi_change(daily(s, d), ["symbol", "exchange"], "day", "oi")
)
R.add("o17_premium", with_views("chain", ", p as (select expiry, sum(case when side = 'CE' then ltp else -ltp end) as x from chain where strike in (110, 125, 140) group by 1) select expiry, round(abs(x), 6) as combined, case when x >= 0 then 'debit' else 'credit' end as tag from p"))(
    lambda s, d: chain(s, d).where("strike in (110, 125, 140)").groupBy("expiry").agg(F.sum(F.when(F.col("side") == "CE", F.col("ltp")).otherwise(-F.col("ltp"))).alias("x"))
    .select("expiry", F.round(F.abs("x"), 6).alias("combined"), F.when(F.col("x") >= 0, "debit").otherwise("credit").alias("tag"))
)
R.add("o18_leg_oi", with_views("daily", "select symbol, exchange, count(*) n, bool_or(oi > 0) as has_oi from daily group by 1, 2"))(lambda s, d: daily(s, d).groupBy("symbol", "exchange").agg(F.count("*").alias("n"), F.max(F.col("oi") > 0).alias("has_oi")))
R.add("o20_expiries", "select name, exchange, cast(count(distinct expiry) as bigint) as expiries from symtoken where instrumenttype in ('CE', 'PE', 'FUT') and trim(expiry) <> '' group by 1, 2")(
    lambda s, d: table(s, d, "symtoken").where("instrumenttype in ('CE', 'PE', 'FUT') and trim(expiry) <> ''").groupBy("name", "exchange").agg(F.count_distinct("expiry").alias("expiries"))
)
_FORM = options.SYMBOL_FORM
R.add("o21_symbol_parts", f"select distinct symbol, regexp_extract(symbol, '{_FORM}', 1) as base, regexp_extract(symbol, '{_FORM}', 2) as expiry, regexp_extract(symbol, '{_FORM}', 3) as strike, regexp_extract(symbol, '{_FORM}', 4) as kind from symtoken")(
    lambda s, d: table(s, d, "symtoken").select("symbol").distinct().select("symbol", *[c.alias(n) for n, c in options.parse_symbol(F.col("symbol")).items()])
)
R.add("o22_year_fraction", "select p_partkey, round(greatest(0.0001, (1790000000.0 - (1760000000 + p_partkey * 100000)) / (365.0 * 86400)), 8) as years from part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.round(options.year_fraction(F.lit(1790000000.0), F.lit(1760000000) + F.col("p_partkey") * 100000), 8).alias("years"))
)
_NET = "sum(case when side = 'CE' then 1 else -1 end * exp(-power((ln(x / strike) + iv * iv * 0.1 / 2) / (iv * sqrt(0.1)), 2) / 2) / sqrt(2 * pi()) / (x * iv * sqrt(0.1)) * oi)"
R.add("sim17_gamma_flip", with_views("chain", _V + f""", g as (select expiry, i, 112.5::double + i * (25.0::double / 240) as x, {_NET.replace('x', '(112.5::double + i * (25.0::double / 240))').replace('e(112.5::double + i * (25.0::double / 240))p', 'exp')} as y from v, range(241) z(i) where iv > 0 group by 1, 2),
    s as (select *, lead(x) over (partition by expiry order by i) x2, lead(y) over (partition by expiry order by i) y2 from g), f as (select expiry, x + (x2 - x) * y / (y - y2) as flip from s where y * y2 < 0)
    select expiry, round(arg_min(flip, (abs(flip - 125), flip)), 4) as flip from f group by 1"""))(lambda s, d: options.gamma_flip(_vol(s, d), _SPOT, 0.1).withColumn("flip", F.round("flip", 4)))  # fmt: skip

# ---- scalar families
R.add("sc1_strings", "select p_partkey, upper(trim(p_name)) as up, split_part(p_name, ' ', 1) as first, replace(p_brand, '#', '-') as brand, starts_with(p_name, 'red') as red, lpad(cast(p_size as varchar), 4, '0') as padded, regexp_full_match(p_brand, 'Brand#[0-9]+') as ok from part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("up"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"), F.col("p_name").startswith("red").alias("red"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.col("p_brand").rlike("^Brand#[0-9]+$").alias("ok"))
)
R.add("sc2_build_symbol", "select p_partkey, 'NAME' || upper(strftime(date '2026-01-01' + p_size, '%d%b%y')) || case when p_retailprice = floor(p_retailprice) then cast(cast(p_retailprice as bigint) as varchar) else cast(p_retailprice as varchar) end || 'CE' as symbol from part")(
    lambda s, d: table(s, d, "part").select("p_partkey", options.option_symbol(F.lit("NAME"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size")), F.col("p_retailprice"), F.lit("CE")).alias("symbol"))
)
R.add("sc4_interval_parse", "select * from (values ('5m', 5, 'm', '1m'), ('2h', 2, 'h', '1m'), ('W', 1, 'W', 'D'), ('7M', 7, 'M', 'D')) v(text, n, unit, source)")(
    lambda s, d: s.createDataFrame([(t, i.count, i.unit, i.source) for t in ("5m", "2h", "W", "7M", "0m", "5x", "100001m") if (i := parse_interval(t))], "text string, n int, unit string, source string")
)
R.add("sc5_dates", "select o_orderkey, cast(epoch(o_orderdate) as bigint) as secs, weekofyear(o_orderdate)::int as week, quarter(o_orderdate)::int as q, isodow(o_orderdate)::int as dow, cast(o_orderdate + interval 3 month as date) as later, date_diff('day', date '1995-01-01', o_orderdate::date)::int as days from orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("secs"), F.weekofyear("o_orderdate").alias("week"), F.quarter("o_orderdate").alias("q"), (F.weekday("o_orderdate") + 1).alias("dow"), F.add_months(F.to_date("o_orderdate"), 3).alias("later"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("days"))
)
R.add("sc6_trading_days", """select exchange, session_date, lag(session_date) over w as prev, lead(session_date) over w as next, session_date = min(session_date) over (partition by exchange, date_trunc('week', session_date)) as opens_week,
    session_date = max(session_date) over (partition by exchange, date_trunc('month', session_date)) as closes_month from trading_calendar window w as (partition by exchange order by session_date)""")(
    lambda s, d: table(s, d, "trading_calendar").select("exchange", "session_date", F.lag("session_date").over(Window.partitionBy("exchange").orderBy("session_date")).alias("prev"), F.lead("session_date").over(Window.partitionBy("exchange").orderBy("session_date")).alias("next"),
        (F.col("session_date") == F.min("session_date").over(Window.partitionBy("exchange", F.date_trunc("week", "session_date")))).alias("opens_week"), (F.col("session_date") == F.max("session_date").over(Window.partitionBy("exchange", F.date_trunc("month", "session_date")))).alias("closes_month"))
)
R.add("sc7_math", "select p_partkey, round(sqrt(p_size), 8) as root, round(ln(p_retailprice), 8) as logn, round(power(p_size, 1.5), 6) as pow, sign(p_size - 25)::int as sgn, greatest(10, least(40, p_size)) as clipped, floor(p_retailprice / 7)::bigint as fl from part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.round(F.sqrt("p_size"), 8).alias("root"), F.round(F.log("p_retailprice"), 8).alias("logn"), F.round(F.pow("p_size", F.lit(1.5)), 6).alias("pow"), F.signum(F.col("p_size") - 25).cast("int").alias("sgn"), mathx.clip(F.col("p_size"), 10, 40).cast("int").alias("clipped"), F.floor(F.col("p_retailprice") / 7).alias("fl"))
)
R.add("sc8_normal", "select p_size, round(any_value(" + _CDF.format(x="zz") + "), 8) as cdf, round(any_value(exp(-zz * zz / 2) / sqrt(2 * pi())), 8) as pdf from (select distinct p_size, (p_size - 25) / 10.0::double as zz from part) group by 1")(
    lambda s, d: table(s, d, "part").select("p_size").distinct().withColumn("z", (F.col("p_size") - 25) / 10.0).select("p_size", F.round(mathx.norm_cdf(F.col("z")), 8).alias("cdf"), F.round(mathx.norm_pdf(F.col("z")), 8).alias("pdf"))
)
R.add("sc9_arrays", with_views("long", "select symbol, cast(len(a) as int) as n, round(list_max(a), 4) as top, round(a[1], 4) as first, round(list_sum(list_transform(a[1:5], lambda x: x * 2)), 4) as doubled from (select symbol, list(close order by day) as a from long group by 1)"))(
    lambda s, d: long_series(s, d).groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "close"))), lambda x: x.close).alias("a"))
    .select("symbol", F.size("a").alias("n"), F.round(F.array_max("a"), 4).alias("top"), F.round(F.col("a")[0], 4).alias("first"), F.round(F.aggregate(F.slice("a", 1, 5), F.lit(0.0), lambda t, x: t + x * 2), 4).alias("doubled"))
)
R.add("sc10_maps", "select status, coalesce(case status when 'success' then 'ok' when 'failed' then 'bad' end, 'other') as label, count(*) n from job_items group by 1, 2")(
    lambda s, d: table(s, d, "job_items").groupBy("status", F.coalesce(F.try_element_at(F.create_map(F.lit("success"), F.lit("ok"), F.lit("failed"), F.lit("bad")), F.coalesce("status", F.lit(""))), F.lit("other")).alias("label")).agg(F.count("*").alias("n"))
)
R.add("sc11_json", "select id, json_extract_string(order_data, '$.symbol') as symbol, cast(json_extract_string(order_data, '$.quantity') as bigint) as quantity from pending_orders where json_extract_string(order_data, '$.symbol') is not null")(
    lambda s, d: table(s, d, "pending_orders").select("id", F.from_json("order_data", "symbol string, quantity bigint").alias("j")).where("j.symbol is not null").select("id", "j.symbol", "j.quantity")
)
R.add("sc12_safe_divide", "select id, coalesce(records_downloaded, 0) as n, round(coalesce(1000.0 / nullif(records_downloaded, 0), 0), 8) as inv from (select distinct id, records_downloaded from job_items)")(
    lambda s, d: table(s, d, "job_items").select("id", "records_downloaded").distinct().select("id", F.coalesce("records_downloaded", F.lit(0)).alias("n"), F.round(mathx.safe_div(F.lit(1000.0), F.col("records_downloaded"), 0.0), 8).alias("inv"))
)
R.add("sc13_units", with_views("bars", "select interval, round(sum(close * volume) / 1e7, 2) as crore, cast(sum(volume // 25) as bigint) as lots from bars group by 1"))(
    lambda s, d: bars(s, d).groupBy("interval").agg(F.round(F.sum(F.col("close") * F.col("volume")) / 1e7, 2).alias("crore"), F.sum(F.expr("volume div 25")).alias("lots"))
)
R.add("sc14_classify", "select case when regexp_matches(upper(name), 'ETF|BEES|GOLD|LIQUID') then 'fund' else 'stock' end as kind, count(*) n from symtoken group by 1")(
    lambda s, d: table(s, d, "symtoken").groupBy(F.when(F.upper("name").rlike("ETF|BEES|GOLD|LIQUID"), "fund").otherwise("stock").alias("kind")).agg(F.count("*").alias("n"))
)
R.add("sc15_grades", "select case when p_size >= 40 then 'A' when p_size >= 30 then 'B' when p_size >= 20 then 'C' else 'D' end as grade, count(*) n from part group by 1")(
    lambda s, d: table(s, d, "part").groupBy(F.when(F.col("p_size") >= 40, "A").when(F.col("p_size") >= 30, "B").when(F.col("p_size") >= 20, "C").otherwise("D").alias("grade")).agg(F.count("*").alias("n"))
)
R.add("sc16_hash_seed", "select symbol, cast(('0x' || substr(sha256(symbol), 1, 8)) as bigint) as seed from (select distinct symbol from market_data)")(
    lambda s, d: table(s, d, "market_data").select("symbol").distinct().select("symbol", mathx.seed_of(F.col("symbol")).alias("seed"))
)
R.add("sc17_expression", with_views("bars", "select interval, round(avg((high - low) / close * 100), 6) as value from bars group by 1"))(lambda s, d: bars(s, d).groupBy("interval").agg(F.round(F.avg(F.expr("(high - low) / close * 100")), 6).alias("value")))
R.add("sc18_quadrants", with_views("long", ", q as (select symbol, day, 100 * close / avg(close) over (partition by symbol order by day rows between 13 preceding and current row) as x, 100 * close / lag(close) over (partition by symbol order by day) as y from long) select case when x >= 100 and y >= 100 then 'leading' when x >= 100 then 'weakening' when y >= 100 then 'improving' else 'lagging' end as quadrant, count(*) n from q where y is not null group by 1"))(
    lambda s, d: long_series(s, d).select("symbol", (F.col("close") * 100 / F.avg("close").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(-13, 0))).alias("x"), (F.col("close") * 100 / F.lag("close").over(Window.partitionBy("symbol").orderBy("day"))).alias("y")).where("y is not null")
    .groupBy(F.when((F.col("x") >= 100) & (F.col("y") >= 100), "leading").when(F.col("x") >= 100, "weakening").when(F.col("y") >= 100, "improving").otherwise("lagging").alias("quadrant")).agg(F.count("*").alias("n"))
)
R.add("sc19_zones", "select event_id, cast(epoch_us((ts at time zone 'UTC') at time zone 'Asia/Kolkata') // 1000000 as bigint) as ist, cast(epoch_us((ts at time zone 'UTC') at time zone 'America/New_York') // 1000000 as bigint) as ny from events")(
    lambda s, d: table(s, d, "events").select("event_id", *[F.floor(F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), z)) / 1000000).alias(n) for n, z in (("ist", "Asia/Kolkata"), ("ny", "America/New_York"))])
)
