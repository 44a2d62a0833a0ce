"""Queries of ticks over odd prices and over many of them."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillbar.operators import align
from tests.compare import compare, duck

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _events(spark, tmp_path, rows):
    """rows: (event_id, minutes, symbol, price)."""
    at = lambda m: None if m is None else dt.datetime(2026, 1, 5) + dt.timedelta(minutes=m)
    spark.createDataFrame([(i, at(m), 1, k, v, '{"k": 1}') for i, m, k, v in rows], EVENTS).write.parquet(f"{tmp_path}/events.parquet")


def _same(spark, tmp_path, query):
    df = entry.queries()[query](spark, str(tmp_path))
    n, a, b = compare(df, duck(str(tmp_path)), entry.oracle_sql()[query])
    assert (a, b) == ([], [])
    return n


def test_nearest_strike_of_odd_prices(spark, tmp_path):
    prices = [None, float("nan"), float("inf"), float("-inf"), 1e300, -1e300, -0.0, 109.0, 110.0, 115.0, 115.01, 349.0, 351.0, 600.0, 700.0]
    _events(spark, tmp_path, [(i, i, "view", v) for i, v in enumerate(prices)] + [(50, 1, "view", None), (50, 2, "view", 124.0), (50, 3, "click", 612.0), (51, 4, "view", 105.0), (51, 4, "view", 605.0)])
    spark.createDataFrame([(1,), (2,), (2,), (50,), (None,)], "p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert _same(spark, tmp_path, "j17_nearest_strike") == len(prices) + 2
    got = {r.event_id: r.nearest for r in entry.queries()["j17_nearest_strike"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 9, 10, 14, 50, 51)] == [110.0, 110.0, 110.0, 110.0, 110.0, 110.0, 120.0, 600.0, 120.0, 110.0]


def test_no_nearest_strike_without_parts(spark, tmp_path):
    _events(spark, tmp_path, [(1, 1, "view", 5.0)])
    spark.createDataFrame([], "p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert _same(spark, tmp_path, "j17_nearest_strike") == 0


def test_nearest_strike_of_many_prices_of_one_key(spark):
    p = spark.range(60_000).select(F.lit(1).alias("k"), (F.col("id") % 7000 / 10).alias("p"))
    s = spark.range(1, 51).select(F.lit(1).alias("k"), (F.col("id") * 10.0 + 100).alias("t"))
    began = time.monotonic()
    r = align.nearest(p, s, "k", "p", "t").agg(F.count("*").alias("n"), F.sum("nearest").alias("total")).first()
    assert time.monotonic() - began < 30  # rows times rows took minutes
    want = [min((100.0 + 10 * k for k in range(1, 51)), key=lambda t: (abs(t - i % 7000 / 10), t)) for i in range(7000)]
    assert (r.n, r.total) == (60_000, sum(want[i % 7000] for i in range(60_000)))


def test_warnings_after_a_price_of_zero(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    prices = [5.0, 0.0, 5.0, 5.5, -0.0, 0.0, 0.0, None, 0.0, None, None, 4.0, 0.0, -3.0, nan, 1.0, 0.0, nan, 0.0, inf, inf, 2.0, 1e300, 1e-300, 1e300, 1e300]
    rows = [(i, i, "view", v) for i, v in enumerate(prices)]
    rows += [(100, 5, "click", 0.0), (101, 60, "click", 0.0), (102, None, "click", 7.0), (103, 95, "click", 7.0), (None, 95, "click", 7.1), (104, 0, None, 0.0), (105, 1, None, 3.0), (106, 90, "view", None)]
    _events(spark, tmp_path, rows)
    assert _same(spark, tmp_path, "st10_tick_warnings") > 0
    got = {r.event_id: (r.jumped, r.stale) for r in entry.queries()["st10_tick_warnings"](spark, str(tmp_path)).collect()}
    assert [got.get(i) for i in (1, 2, 3, 6, 7, 9, 101, 102, 103, 105, 106)] == [(True, False), (True, False), None, (True, False), None, None, (True, True), None, (True, True), (True, False), (None, True)]
