from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillbar.functions.intervals import Interval, parse_interval
from quillbar.operators import archive, resample

SCHEMA = "symbol string, exchange string, interval string, timestamp bigint, open double, high double, low double, close double, volume bigint, oi bigint"
E = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())


def _bars(spark, interval, stamps):
    return spark.createDataFrame([("AAA", "NSE", interval, t, i + 1.0, i + 3.0, float(i), i + 2.0, 10, i) for i, t in enumerate(stamps)], SCHEMA)


@pytest.mark.parametrize("text", ["", "0m", "5x", "m5", "100001m", "5 m", None])
def test_no_interval(text):
    assert parse_interval(text) is None


def test_grammar_is_case_sensitive():
    assert parse_interval("7m") == Interval(7, "m") and parse_interval("7M") == Interval(7, "M")
    assert parse_interval("W").source == "D" and parse_interval("2h").source == "1m"


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_calendar_buckets_in_any_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        two = resample.resample(_bars(spark, "D", [E(2020, 12, 28, 3, 45), E(2021, 1, 4, 3, 45)]), "2W").collect()
        assert [r.timestamp for r in two] == [E(2020, 12, 28)]
        seven = resample.resample(_bars(spark, "D", [E(2025, 12, 15, 3, 45), E(2026, 1, 15, 3, 45)]), "7M").collect()
        assert [(r.timestamp, r.open, r.close, r.volume) for r in seven] == [(E(2025, 12, 1), 1.0, 3.0, 20)]
        d = _bars(spark, "D", [E(2026, 10, 1, 3, 45), E(2026, 10, 2, 3, 45)])
        assert sum(r.volume for r in resample.resample(d, "2D").collect()) == 20
        assert sorted(r.timestamp for r in resample.resample(d, "D").collect()) == [E(2026, 10, 1, 3, 45), E(2026, 10, 2, 3, 45)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize(("text", "n"), [("7m", 420), ("2h", 7200)])
def test_intraday_starts_again_every_day(spark, text, n):
    o = E(2026, 10, 1, 3, 45)
    got = sorted((r.timestamp, r.volume) for r in resample.resample(_bars(spark, "1m", [o, o + 60, o + n, o + 86400]), text).collect())
    assert got == [(o, 20), (o + n, 10), (o + 86400, 10)]


def test_windows(spark):
    day = E(2026, 1, 5) - 19800
    rows = [(s, x, i, day + k * 86400, 100.0, 102.0, 99.0, 101.0, 1000, 0) for s, x, i in (("AAA", "NSE", "D"), ("BBB", "NSE", "D"), ("AAA", "IDX", "D"), ("AAA", "NSE", "1m")) for k in range(3)]
    b = spark.createDataFrame(rows, SCHEMA)
    req = [("a", "aaa", "NSE", "D", day, day + 2 * 86400), ("b", "BBB", "NSE", "D", day + 86400, day + 3 * 86400), ("c", "AAA", "NSE", "D", day + 2 * 86400, day + 3 * 86400), ("d", "UNKNOWN", "NSE", "D", day, day + 3 * 86400)]
    assert {r.request_id: r.n for r in archive.read_many(b, req).collect()} == {"a": 2, "b": 2, "c": 1, "d": 0}
    assert archive.read_window(b, "aaa", "NSE", "D", day, day + 9e9, 3).count() == 3
    with pytest.raises(Exception, match="window holds more"):
        archive.read_window(b, "aaa", "NSE", "D", day, day + 9e9, 2).collect()


def test_upsert_is_idempotent(spark):
    b = _bars(spark, "D", [100, 200])
    new = _bars(spark, "D", [200, 300]).withColumn("close", F.lit(9.0))
    once = archive.upsert(b, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, archive.upsert(once, new).collect()))
    assert {r.timestamp: r.close for r in once.collect()} == {100: 2.0, 200: 9.0, 300: 9.0}
    c = archive.catalog(once).first()
    assert (c.first_ts, c.last_ts, c.records) == (100, 300, 3)


def test_archive_round_trip_and_export(spark, tmp_path):
    b = _bars(spark, "D", [100, 200]).unionByName(_bars(spark, "1m", [100]))
    archive.write_archive(b, str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.where("interval = '1m'").count() == 1 and back.count() == 3
    archive.export(b, str(tmp_path / "c"), "csv", "gzip", ["symbol"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3


def test_unknown_dominates_and_gates(spark):
    r = spark.range(1).select(archive.gate_and(F.lit(False), F.lit(None).cast("boolean")).alias("a"), archive.gate_or(F.lit(True), F.lit(None).cast("boolean")).alias("b")).first()
    assert r.a is None and r.b is True
    with pytest.raises(ValueError):
        archive.condition("close; drop", ">", 1)


def test_scan_gets_filters_and_columns(spark, tmp_path):
    p = str(tmp_path / "b")
    _bars(spark, "1m", range(1000)).write.parquet(p)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = archive.read_window(spark.read.parquet(p), "AAA", "NSE", "1m", 10, 20, 100).select("close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp,10)" in plan and "open" not in plan.split("ReadSchema")[1][:200]
