from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbar.functions import mathx
from quillbar.operators import align, books, options, portfolio, research, series, sip

D = dt.date


def test_normal_distribution(spark):
    x = [i / 7 for i in range(-70, 71)]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", mathx.norm_cdf(F.col("x")).alias("y")).collect()
    assert max(abs(r.y - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) for r in got) < 1e-13


@pytest.mark.parametrize(
    ("flows", "want"),
    [
        ([(D(2008, 1, 1), -10000), (D(2008, 3, 1), 2750), (D(2008, 10, 30), 4250), (D(2009, 2, 15), 3250), (D(2009, 4, 1), 2750)], 0.373362535),
        ([(D(2020, 1, 1), -100000), (D(2023, 1, 1), 100000)], 0.0),
        ([(D(2021, 1, 1), -1000), (D(2022, 1, 1), 2000)], 1.0),
        ([(D(2020, 1, 1), -1000), (D(2021, 1, 1), 2000)], 2 ** (365 / 366) - 1),
        ([(D(2020, 1, 1), 1000), (D(2021, 1, 1), 2000)], None),
        ([(D(2020, 1, 1), -1000), (D(2020, 1, 1), 2000)], None),
        ([(D(2020, 1, 1), -1000)], None),
    ],
)
def test_money_weighted_return(spark, flows, want):
    r = sip.xirr(spark.createDataFrame([("p", d, float(a)) for d, a in flows], "symbol string, day date, amount double")).first()
    assert (r.xirr is None or math.isnan(r.xirr)) if want is None else r.xirr == pytest.approx(want, abs=1e-6)


def test_flat_plan(spark):
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(182) if (D(2020, 1, 1) + dt.timedelta(days=i)).weekday() < 5]
    s = spark.createDataFrame([("A", d, 100.0) for d in days], "symbol string, day date, close double")
    span = spark.createDataFrame([("A", D(2020, 1, 1), D(2020, 6, 30))], "symbol string, lo date, hi date")
    plan = sip.schedule(span, s, "monthly", 5).join(s.withColumnRenamed("day", "session"), ["symbol", "session"]).withColumn("amount", F.lit(10000.0))
    r = sip.headline(sip.run_plan(plan), s.where("day = '2020-06-30'")).first()
    assert (r.installments, r.invested, r.units, r.value) == (6, 60000.0, 600.0, 60000.0)
    c = sip.run_plan(plan, charge=0.01).first()
    assert c.cash >= 0 and c.units * 100 + c.charges + c.cash == pytest.approx(60000)


def test_exposure_and_walls(spark):
    ch = spark.createDataFrame([("n", 20000.0, "CE", 1e6, 0.001, 0.5), ("n", 20000.0, "PE", 5e5, 0.001, -0.5), ("n", 20100.0, "CE", 10.0, None, None)], "expiry string, strike double, side string, oi double, gamma double, delta double")
    r = {x.strike: x for x in options.exposure(ch, 20000.0).collect()}
    a = r[20000.0]
    assert (round(a.ce_gex, 6), round(a.pe_gex, 6), round(a.gex, 6), round(a.dex, 6), a.unpriced) == (400.0, -200.0, 200.0, 500.0, False)
    assert r[20100.0].unpriced and r[20100.0].gex == 0


@pytest.mark.parametrize(("p", "i", "want"), [(23587.5, 50, 23600), (23574, 50, 23550), (292.3, 2.5, 292.5), (44000, 100, 44000)])
def test_atm(spark, p, i, want):
    assert spark.range(1).select(options.atm_strike(F.lit(float(p)), F.lit(float(i)))).first()[0] == want


def test_volatility_round_trip_and_limits(spark):
    rows = [(100.0, float(k), 0.5, s, c) for k in (60, 90, 100, 110, 160) for s in (0.1, 0.4, 1.5) for c in (True, False)]
    df = spark.createDataFrame(rows, "f double, k double, t double, s double, c boolean")
    df = df.withColumn("x", options.black76(F.col("f"), F.col("k"), F.col("t"), F.col("s"), F.col("c"))).where("x > greatest(0, if(c, f - k, k - f)) + 1e-7")
    assert all(abs(r.iv - r.s) < 1e-5 for r in options.implied_volatility(df, "f", "k", "t", "x", "c").collect())
    bad = spark.createDataFrame([(100.0, 90.0, 0.5, 5.0, True), (100.0, 90.0, 0.0, 15.0, True), (None, 90.0, 0.5, 15.0, True), (100.0, 90.0, 0.5, 99.999, True), (100.0, 90.0, 0.5, 15.0, None)], "f double, k double, t double, x double, c boolean")
    assert [r.iv for r in options.implied_volatility(bad, "f", "k", "t", "x", "c").collect()] == [None] * 5


def test_simulation_without_costs_equals_closed_forms(spark):
    rng = np.random.default_rng(3)
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(150)]
    long = spark.createDataFrame([(s, d, float(x)) for s in "AB" for d, x in zip(days, 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 150))))], "symbol string, day date, close double")
    w = spark.createDataFrame([("A", 1.0), ("B", 3.0)], "symbol string, weight double")
    sc = spark.createDataFrame([(n, s, x, r, 0.05, c, 1000.0) for n, r, c in (("h", "none", 0.0), ("m", "month", 0.0), ("c", "month", 0.01), ("b", "band", 0.0)) for s, x in (("A", 1.0), ("B", 3.0))], "scenario string, symbol string, weight double, rule string, band double, cost_rate double, capital double")
    sim = portfolio.simulate(long, sc).toPandas()
    v = {n: g.sort_values("day").value.to_numpy() for n, g in sim.groupby("scenario")}
    np.testing.assert_allclose(v["h"], portfolio.buy_and_hold(long, w, 1000.0).orderBy("day").toPandas().value, rtol=1e-12)
    np.testing.assert_allclose(v["m"], portfolio.calendar_rebalanced(long, w, 1000.0).orderBy("day").toPandas().value, rtol=1e-9)
    assert v["c"][-1] < v["m"][-1] and np.allclose(sim[sim.scenario == "c"].gross, v["m"])
    with pytest.raises(Exception, match="weights"):
        portfolio.normalise_weights(spark.createDataFrame([("A", -1.0)], "symbol string, weight double")).collect()


def test_clusters_follow_chains(spark):
    p = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.7), ("d", "e", 0.61), ("c", "d", 0.1)], "a string, b string, corr double")
    m = spark.createDataFrame([(x,) for x in "abcdef"], "symbol string")
    assert {r.symbol: r.cluster for r in portfolio.clusters(p, m).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_fills_through_zero(spark):
    f = spark.createDataFrame([("x", 1, 10.0, 100.0), ("x", 2, 10.0, 110.0), ("x", 3, -25.0, 120.0), ("x", 4, 5.0, 90.0), ("y", 1, -1.0, 5.0)], "k string, n int, qty double, price double")
    r = [(x.position, x.average, x.realized) for x in books.book_fills(f, ["k"], ["n"]).orderBy("k", "n").collect()]
    assert r == [(10, 100, 0), (20, 105, 0), (-5, 120, 300), (0, 0, 450), (-1, 5, 0)]


def test_asof_against_loop(spark):
    rng = np.random.default_rng(0)
    lt = [(i, int(k), int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 50, 80)))]
    rt = sorted({(int(k), int(t)) for k, t in zip(rng.integers(0, 3, 60), rng.integers(0, 50, 60))})
    a, b = spark.createDataFrame(lt, "i int, k int, t int"), spark.createDataFrame([(k, t, t * 2.0) for k, t in rt], "k int, t int, v double")
    for strict in (True, False):
        got = {r.i: r.asof_v for r in align.asof_backward(a, b, "k", "t", ["v"], strict).collect()}
        for i, k, t in lt:
            c = [y for x, y in rt if x == k and (y < t if strict else y <= t)]
            assert got[i] == (max(c) * 2.0 if c else None)
    got = {r.i: r.matched_at for r in align.asof_forward(a, b, "k", "t").collect()}
    assert all(got[i] == min((y for x, y in rt if x == k and y >= t), default=None) for i, k, t in lt)
    near = {r.i: r.nearest for r in align.nearest(a.withColumnRenamed("t", "p"), b, "k", "p", "t").collect()}
    assert all(near[i] == min((y for x, y in rt if x == k), key=lambda y: (abs(y - t), y)) for i, k, t in lt)


def test_quadrants_and_weighted_mean(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 9])], "symbol string, day int, close double")
    assert [r.w for r in df.select(series.weighted_mean("close", 3, series.by()).alias("w")).collect()] == [None, None, 14 / 6, 35 / 6]


def test_relative_strength_and_actions(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(130)]
    s = spark.createDataFrame([("A", d, 120.0 if i == 119 else 100.0) for i, d in enumerate(days)], "symbol string, day date, close double")
    b = spark.createDataFrame([(d, 1100.0 if i == 119 else 1000.0) for i, d in enumerate(days)], "day date, close double")
    r = {x.day: x.rs for x in research.relative_strength(s, b, 119).collect()}
    assert r[days[119]] == pytest.approx(100 * (1.2 / 1.1 - 1)) and r[days[118]] is None
    act = spark.createDataFrame([("A", days[10], 0.5), ("A", days[20], 0.5)], "symbol string, ex_date date, factor double")
    a = {x.day: x.adjusted for x in research.adjust(s, act, F.lit(days[15])).collect()}
    assert a[days[9]] == pytest.approx(50.0) and a[days[10]] == 100.0


def test_first_exit_rules(spark):
    days = [D(2026, 1, 5) + dt.timedelta(days=i) for i in range(8)]
    def bars(**change):
        rows = [["A", d, 100.0, 102.0, 98.0, 100.0] for d in days]
        for i, v in change.items():
            rows[int(i[1:])][2:] = v
        return spark.createDataFrame([tuple(r) for r in rows], "symbol string, day date, open double, high double, low double, close double")
    sig = spark.createDataFrame([("A", days[0])], "symbol string, day date")
    x = research.first_exit(sig, bars(), 0.05, 0.2, 5).first()
    assert (x.exit_day, x.exit, x.why) == (days[5], 100.0, "time")
    x = research.first_exit(sig, bars(d3=[80.0, 130.0, 70.0, 90.0]), 0.05, 0.2, 5).first()
    assert (x.exit_day, x.exit, x.why) == (days[3], 80.0, "stop")  # the gap fills at the open, the stop comes before the target
    x = research.first_exit(sig, bars(d2=[125.0, 130.0, 110.0, 120.0]), 0.05, 0.2, 5).first()
    assert (x.exit_day, x.exit, x.why) == (days[2], 125.0, "target")


def test_arrays_hold_the_whole_series(spark, tmp_path):
    import __spark_entry__ as entry

    o = spark.range(200).selectExpr("'1-URGENT' as o_orderpriority", "date_add(date '1995-01-01', cast(id as int)) as o_orderdate", "cast(id + 1 as double) as o_totalprice")
    o.write.parquet(f"{tmp_path}/orders.parquet")
    r = entry.queries()["sc9_arrays"](spark, str(tmp_path)).first()
    assert (r.n, r.top, r["first"], r.doubled) == (200, 200.0, 1.0, 30.0)


def test_correlation_matrix_has_every_member(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(s, dt.date(2026, 1, 1) + dt.timedelta(days=k), 100.0 + (k * 7) % 11) for s, n in (("x", 40), ("y", 40), ("z", 10)) for k in range(n)]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = entry.queries()["a16_correlation_matrix"](spark, str(tmp_path)).orderBy("a")
    assert got.columns == ["a", "x", "y", "z"]
    assert [tuple(r) for r in got.collect()] == [("x", 1.0, 1.0, None), ("y", 1.0, 1.0, None), ("z", None, None, None)]
