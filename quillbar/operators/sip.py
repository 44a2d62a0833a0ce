"""Periodic investment plans and money-weighted returns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbar.operators.align import asof_forward

_STEP = {"weekly": (7, 0), "fortnightly": (14, 0), "monthly": (0, 1), "quarterly": (0, 3), "yearly": (0, 12)}


def requested_dates(span: DataFrame, rule: str, day_of_month: int = 1) -> DataFrame:
    """Dates of a plan per key (symbol, lo, hi): every 7 or 14 days from lo, or on
    the given day (28 at most) of each month, quarter or year."""
    days, months = _STEP[rule]
    if days:
        seq = F.sequence("lo", "hi", F.expr(f"interval {days} day"))
    else:
        first = F.date_add(F.trunc("lo", "month"), min(day_of_month, 28) - 1)
        seq = F.filter(F.sequence(first, F.col("hi"), F.expr(f"interval {months} month")), lambda d: d >= F.col("lo"))
    return span.where("lo <= hi").select("symbol", F.posexplode(seq).alias("n", "day"))


def step_up(base: float, yearly: float, day: Column, start: Column) -> Column:
    """Amount raised by a share after each full 365 days."""
    return F.lit(base) * F.pow(F.lit(1.0 + yearly), F.floor(F.datediff(day, start) / 365))


def schedule(span: DataFrame, sessions: DataFrame, rule: str, day_of_month: int = 1) -> DataFrame:
    """Requested dates and the first session on or after each; what falls beyond the last session is dropped."""
    r = requested_dates(span, rule, day_of_month)
    return asof_forward(r, sessions, "symbol", "day").where("matched_at is not null").select("symbol", "n", F.col("day").alias("requested"), F.col("matched_at").alias("session"))


def run_plan(installments: DataFrame, whole: bool = True, charge: float = 0.0) -> DataFrame:
    """Buys per key in order (symbol, session, close, amount): the budget is the
    amount plus carried cash; with whole shares the quantity is rounded down, one
    less when the charge would not fit; the rest is carried.

    The recurrence runs over one key's installments as an ordered array, inside
    the JVM; a plan has one installment per period, which bounds the array."""
    items = F.array_sort(F.collect_list(F.struct("session", "close", "amount", "n")))
    d0 = lambda v: F.lit(v).cast("double")
    zero = F.struct(d0(0).alias("cash"), d0(0).alias("units"), d0(0).alias("invested"), d0(0).alias("charges"))

    def buy(a: Column, x: Column) -> Column:
        budget = a.cash + x.amount
        q = F.floor(budget / x.close).cast("double") if whole else budget / (x.close * (1 + charge))
        if whole and charge:
            q = F.when(q * x.close * (1 + charge) > budget, F.greatest(d0(0), q - 1)).otherwise(q)
        fee = q * x.close * charge
        return F.struct((budget - q * x.close - fee).alias("cash"), (a.units + q).alias("units"), (a.invested + x.amount).alias("invested"), (a.charges + fee).alias("charges"))

    g = installments.groupBy("symbol").agg(items.alias("_i"))
    out = g.withColumn("_r", F.aggregate("_i", zero, buy))
    return out.select("symbol", F.size("_i").alias("installments"), F.col("_r.units").alias("units"), F.col("_r.cash").alias("cash"), F.col("_r.invested").alias("invested"), F.col("_r.charges").alias("charges"))


def headline(plan: DataFrame, last: DataFrame) -> DataFrame:
    """Value, multiple and average cost of a finished plan."""
    j = plan.join(last.select("symbol", F.col("close").alias("price")), "symbol")
    v = F.col("units") * F.col("price") + F.col("cash")
    return j.select("symbol", "installments", "units", "invested", v.alias("value"), (v / F.col("invested")).alias("multiple"), (v / F.col("invested") - 1).alias("return_abs"), F.when(F.col("units") > 0, (F.col("invested") - F.col("cash")) / F.col("units")).alias("average_cost"))


def lump_sum(first: DataFrame, last: DataFrame, amount: float) -> DataFrame:
    """One purchase of whole shares on the first session."""
    j = first.select("symbol", F.col("close").alias("p0")).join(last.select("symbol", F.col("close").alias("p1")), "symbol")
    q = F.floor(F.lit(amount) / F.col("p0"))
    return j.select("symbol", q.cast("double").alias("units"), (q * F.col("p1") + (F.lit(amount) - q * F.col("p0"))).alias("value"))


def xirr_of(days: np.ndarray, amounts: np.ndarray) -> float | None:
    """Yearly rate at which the flows are worth nothing (days / 365), by bisection
    on [-0.9999, 100]; None without flows of both signs, on two days at least, or
    without a change of sign in the bracket."""
    if len(days) < 2 or not (amounts > 0).any() or not (amounts < 0).any() or days.min() == days.max():
        return None
    t = (days - days.min()) / 365.0
    f = lambda r: float((amounts / (1 + r) ** t).sum())
    lo, hi = -0.9999, 100.0
    a, b = f(lo), f(hi)
    if a == 0:
        return lo
    if a * b > 0:
        return None
    for _ in range(200):
        m = (lo + hi) / 2
        y = f(m)
        if y == 0 or hi - lo < 1e-14:
            break
        if a * y < 0:
            hi = m
        else:
            lo, a = m, y
    return (lo + hi) / 2


def xirr(flows: DataFrame, key: str = "symbol") -> DataFrame:
    """Money-weighted return per key (key, day, amount); flows of a day are added
    up first. The flows of one plan fit a row as an array."""
    d = flows.groupBy(key, "day").agg(F.sum("amount").alias("amount")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.unix_date("day").alias("d"), F.col("amount").alias("a")))).alias("f"))
    flat = d.select(key, F.transform("f", lambda x: x.d).alias("d"), F.transform("f", lambda x: x.a).alias("a"))
    kind = flows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "xirr": pd.Series([xirr_of(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(b["d"], b["a"])], index=b.index, dtype="float64")})

    return flat.mapInPandas(run, f"{key} {kind}, xirr double")


def rolling_plans(sessions: DataFrame, years: list[int], step_months: int, amount: float) -> DataFrame:
    """Plan of monthly purchases for every start (each ``step_months`` months) and
    length: value per invested unit, by window sums of 1 / price over month-first
    sessions. Fractional units."""
    m = sessions.groupBy("symbol", F.trunc("day", "month").alias("month")).agg(F.min_by("close", "day").alias("buy"), F.max_by("close", "day").alias("end"))
    idx = F.months_between("month", F.lit("1970-01-01").cast("date")).cast("int")
    m = m.withColumn("i", idx).withColumn("inv", F.lit(amount) / F.col("buy"))
    lo = m.groupBy("symbol").agg(F.min("i").alias("lo"))
    starts = m.join(lo, "symbol").where((F.col("i") - F.col("lo")) % step_months == 0).select("symbol", F.col("i").alias("s"), F.explode(F.array(*[F.lit(y * 12) for y in years])).alias("n"))
    cells = starts.withColumn("i", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)))
    g = cells.join(m, ["symbol", "i"]).groupBy("symbol", "s", "n").agg(F.count("*").alias("k"), F.sum("inv").alias("units"), F.max_by("end", "i").alias("price"))
    return g.where("k = n").select("symbol", F.add_months(F.lit("1970-01-01").cast("date"), F.col("s")).alias("start"), (F.col("n") / 12).cast("int").alias("years"), (F.col("units") * F.col("price") / (F.col("n") * amount)).alias("multiple"))
