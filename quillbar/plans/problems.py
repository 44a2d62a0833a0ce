"""Queries of the general data-preparation problems (p1 to p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbar.operators import references, regrid, rejects, rolling, snapshots, spikes, timestamps
from quillbar.plans import Registry
from quillbar.sources.tables import ist_day, latest_bars, table

R = Registry()

_SQUEEZE = r"nullif(regexp_replace({c}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g'), '')"


def _sq(c: str) -> str:
    return _SQUEEZE.format(c=c)


# ---- records of the contract file, by regular expressions
_FLD = r'(?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)'
_COL = lambda k: rf"""trim(trim(regexp_extract(t, '^(?:{_FLD},){{{k}}}({_FLD})(?:,|$)', 1, 's'), ' ' || chr(9)), '"')"""
_P4_SQL = rf"""
with c as (
  select line_id, file_date, rtrim(ltrim(coalesce(raw_text, ''), chr(65279)), chr(13) || chr(10)) as t from cds_symbols
), s as (
  select *, regexp_full_match(t, '{_FLD}(?:,{_FLD})*', 's') as closed,
    len(regexp_replace(regexp_replace(t, '"(?:[^"]|"")*"', 'Q', 'gs'), '[^,]', '', 'gs')) + 1 as n,
    regexp_matches(t, ',[ \t]*(?:"[ \t]*")?[ \t]*$') as tail,
    {_COL(1)} as token, {_COL(6)} as name, {_COL(10)} as strike
  from c
), r as (
  select *, case
    when lower(trim(t, '" ')) like 'exchange,token,lotsize,precision,multiplier,symbol,tradingsymbol,expiry,instrument,optiontype,strikeprice,ticksize%' then 'header'
    when not closed then 'quoting'
    when not (n = 12 or (n = 13 and tail)) then 'column_count'
    when not (regexp_full_match(token, '[0-9]+') and regexp_matches(token, '[1-9]'))
      or not regexp_full_match(name, '[A-Z0-9.&-]+')
      or not regexp_full_match(strike, '|-1|[0-9]+|[0-9]+[.][0-9]+') then 'value'
  end as reason from s
)"""


# ---- 1: references to records that do not exist
def _orphans(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return references.market_orphans(
        t("download_jobs"), t("job_items"), t("symtoken"), t("sandbox_orders"), rejects.loaded_records(t("cds_symbols"))
    )


_P1_CTE = (
    _P4_SQL
    + rf""", jobs as (
  select upper({_sq('id')}) as k, coalesce(min(created_at), timestamptz '1900-01-01') as since from download_jobs where {_sq('id')} is not null group by 1
), snap as (select distinct snapshot_date d from symtoken where snapshot_date is not null),
es as (select distinct snapshot_date d, upper({_sq('exchange')}) e, upper({_sq('symbol')}) s from symtoken),
tok as (select token k, min(file_date) since from r where reason is null group by 1),
orphans as (
  select distinct 'job_items' as ref_table, i.id as ref_id, strftime(i.started_at, '%Y-%m') as period, upper({_sq('i.job_id')}) as k
  from job_items i left join jobs j on upper({_sq('i.job_id')}) = j.k
  where {_sq('i.job_id')} is not null and (j.k is null or j.since > i.started_at)
  union
  select distinct 'sandbox_orders', o.id, strftime(o.order_timestamp, '%Y-%m'), coalesce(cast(o.d as varchar), 'none') || '|' || o.e || '|' || o.s
  from (select id, order_timestamp, upper({_sq('exchange')}) e, upper({_sq('symbol')}) s,
          (select max(d) from snap where d <= cast(order_timestamp as date)) d from sandbox_orders) o
  left join es on es.d = o.d and es.e = o.e and es.s = o.s
  where o.e is not null and o.s is not null and es.s is null
  union
  select distinct 'symtoken', y.id, strftime(y.snapshot_date, '%Y-%m'), upper({_sq('y.token')})
  from symtoken y left join tok on tok.k = upper({_sq('y.token')})
  where upper({_sq('y.exchange')}) = 'CDS' and {_sq('y.token')} is not null and (tok.k is null or tok.since > y.snapshot_date)
)"""
)


@R.add("p1_found", _P1_CTE + " select distinct ref_table, ref_id from orphans")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id").distinct()


@R.add(
    "p1_report",
    _P1_CTE + " select ref_table, period, cast(count(distinct ref_id) as bigint) orphans, cast(count(distinct k) as bigint) missing_keys from orphans group by all",
)
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


# ---- 2: rolling totals
_P2_SQL = """
with b as (
  select symbol, exchange, interval, timestamp, close, volume, row_number() over (
    partition by symbol, exchange, interval, timestamp order by created_at desc nulls last, close desc nulls last, volume desc nulls last) rn
  from market_data where interval = 'D'
), dd as (
  select symbol, exchange, date '1970-01-01' + cast(floor((timestamp + 19800) / 86400.0) as int) as day,
    sum(coalesce(volume, 0)) v, sum(case when isfinite(close) then close end) s, count(case when isfinite(close) then 1 end) c
  from b where rn = 1 group by all
), cal as (
  select symbol, exchange, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from dd group by symbol, exchange
), j as (
  select cal.*, coalesce(v, 0) v, s, coalesce(c, 0) c from cal left join dd using (symbol, exchange, day)
)
select symbol, exchange, day,
  cast(sum(v) over w7 as bigint) as volume_7d, round(sum(s) over w7 / nullif(sum(c) over w7, 0), 6) as close_avg_7d,
  cast(sum(v) over w30 as bigint) as volume_30d, round(sum(s) over w30 / nullif(sum(c) over w30, 0), 6) as close_avg_30d
from j
window w7 as (partition by symbol, exchange order by day rows between 6 preceding and current row),
  w30 as (partition by symbol, exchange order by day rows between 29 preceding and current row)
"""


@R.add("p2_rolling_totals", _P2_SQL)
def p2_rolling_totals(spark: SparkSession, d: str) -> DataFrame:
    bars = latest_bars(table(spark, d, "market_data").where("interval = 'D'"), "close", "volume")
    daily = bars.select("symbol", "exchange", ist_day("timestamp").alias("day"), "volume", "close")
    return rolling.rolling_totals(daily, ["symbol", "exchange"], "day", "volume", "close")


# ---- 3: mixed timestamp formats and time zones
@R.add("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    values = timestamps.platform_values(table(spark, d, "pending_orders"), table(spark, d, "sandbox_gtt"))
    return timestamps.resolve(values).select(F.col("source").alias("field_name"), "rec_id", "utc_us")


# ---- 4: rows that fail to parse
@R.add("p4_found", _P4_SQL + " select line_id, reason from r where reason is not null and reason <> 'header'")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.failed_records(table(spark, d, "cds_symbols"))


@R.add(
    "p4_loaded",
    _P4_SQL + """ select line_id, file_date, token, name as trading_symbol, try_cast(nullif(strike, '') as double) as strike_price from r where reason is null""",
)
def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loaded_records(table(spark, d, "cds_symbols")).select("line_id", "file_date", "token", "trading_symbol", "strike_price")


# ---- 5: implausible spikes
@R.add("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_bars(table(spark, d, "market_data")).select("symbol", "exchange", "bar_interval", "bar_ts").distinct()


@R.add("p5_report")
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Cases per series and kind."""
    return spikes.implausible_bars(table(spark, d, "market_data")).groupBy("symbol", "exchange", "bar_interval", "why").agg(F.count("*").alias("bars"))


# ---- 6: what changed between full snapshots
_P6_SQL = f"""
with s as (
  select cast(snapshot_date as varchar) as d, {_sq('exchange')} as exchange, {_sq('token')} as token, id, lotsize,
    (case when length({_sq('expiry')}) = 9 then try_strptime({_sq('expiry')}, '%d-%b-%y') else
      coalesce(try_strptime({_sq('expiry')}, '%d-%b-%Y'), try_strptime({_sq('expiry')}, '%Y-%m-%d')) end)::date as expiry,
    round(case when isnan(tick_size) then null else tick_size end, 6) as tick_size
  from symtoken where snapshot_date is not null
), u as (
  select * from (select *, row_number() over (partition by d, exchange, token order by id desc) rn from s where exchange is not null and token is not null) where rn = 1
), n as (select d, lead(d) over (order by d) nx, lag(d) over (order by d) pv from (select distinct d from s))
select u.d as snapshot_date, u.exchange, u.token, case when p.token is null then 'added' else 'changed' end as change_kind
from u join n on n.d = u.d and n.pv is not null
left join u p on p.d = n.pv and p.exchange = u.exchange and p.token = u.token
where p.token is null or p.lotsize is distinct from u.lotsize or p.expiry is distinct from u.expiry or p.tick_size is distinct from u.tick_size
union all
select n.nx, u.exchange, u.token, 'removed' from u join n on n.d = u.d and n.nx is not null
where not exists (select 1 from u q where q.d = n.nx and q.exchange = u.exchange and q.token = u.token)
"""


@R.add("p6_found", _P6_SQL)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.instrument_changes(table(spark, d, "symtoken"))


# ---- 7: irregular readings onto a regular grid
_P7_SQL = """
with step(interval, sec) as (values ('1m', 60), ('5m', 300), ('15m', 900), ('1h', 3600)),
b as (select distinct symbol, exchange, interval, timestamp from market_data),
r as (
  select b.*, sec, open_ts, close_ts, session_date, (timestamp - open_ts) // sec as slot
  from b join step using (interval) join trading_calendar c on c.exchange = b.exchange and timestamp >= open_ts and timestamp < close_ts
), g as (
  select symbol, exchange, interval, session_date, open_ts, sec, unnest(generate_series(min(slot), max(slot))) as slot
  from r group by symbol, exchange, interval, session_date, open_ts, sec
), cal as (select exchange, session_date, row_number() over (partition by exchange order by session_date) as n from trading_calendar),
d as (
  select distinct b.symbol, b.exchange, n from b join cal on cal.exchange = b.exchange
    and session_date = date '1970-01-01' + cast(floor((timestamp + 19800) / 86400.0) as int)
  where interval = 'D'
), dg as (select symbol, exchange, unnest(generate_series(min(n), max(n))) as n from d group by symbol, exchange)
select symbol, exchange, interval as bar_interval, open_ts + slot * sec as slot_ts from g
where not exists (select 1 from r where r.symbol = g.symbol and r.exchange = g.exchange and r.interval = g.interval and r.session_date = g.session_date and r.slot = g.slot)
union all
select dg.symbol, dg.exchange, 'D', cast(epoch(session_date) as bigint) - 19800 from dg join cal on cal.exchange = dg.exchange and cal.n = dg.n
where not exists (select 1 from d where d.symbol = dg.symbol and d.exchange = dg.exchange and d.n = dg.n)
"""


@R.add("p7_found", _P7_SQL)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return regrid.missing_periods(table(spark, d, "market_data"), table(spark, d, "trading_calendar"))


@R.add("p7_grid")
def p7_grid(spark: SparkSession, d: str) -> DataFrame:
    return regrid.session_grid(table(spark, d, "market_data"), table(spark, d, "trading_calendar"))
