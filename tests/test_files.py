from __future__ import annotations

import pytest

from quillbar.operators import archive, resample
from quillbar.sources import connectors as cn

S = "symbol string, exchange string, interval string, timestamp bigint, open double, high double, low double, close double, volume bigint, oi bigint"


def test_import_separates_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_text(" Timestamp ,open,high,low,close,volume\n60,1,2,0.5,1.5,10\n120,1,x,0.5,1.5,10\n180,1,2,1.4,1.2,10\n240,1,2,0.5,1.5,-1\n300,1,2,0.5,1.5,\n360,1,inf,0.5,1.5,1\n")
    good, bad = cn.import_bars(spark, str(tmp_path / "b.csv"), "csv", "abc", "NSE", "1m")
    assert sorted((r.symbol, r.timestamp, r.volume, r.oi) for r in good.collect()) == [("ABC", 60, 10, 0), ("ABC", 300, 0, 0)]
    assert sorted((r.timestamp, r.reason) for r in bad.collect()) == [(120, "value"), (180, "prices"), (240, "prices"), (360, "prices")]
    good.write.parquet(str(tmp_path / "p"))
    again, none = cn.import_bars(spark, str(tmp_path / "p"), "parquet", "abc", "NSE", "1m")
    assert again.count() == 2 and none.count() == 0
    (tmp_path / "c.csv").write_text("timestamp,open\n1,2\n")
    with pytest.raises(ValueError):
        cn.import_bars(spark, str(tmp_path / "c.csv"), "csv", "abc", "NSE", "1m")
    with pytest.raises(ValueError):
        cn.import_bars(spark, str(tmp_path / "c.csv"), "xml", "abc", "NSE", "1m")


def test_append_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, t int")
    rows(("a", 1), ("a", 2), ("b", 5)).write.parquet(path)
    new = rows(("a", 2), ("a", 3), ("b", 4), ("c", 0))
    assert sorted(map(tuple, archive.append_new(new, path, ["k"], "t").collect())) == [("a", 3), ("c", 0)]
    assert archive.append_new(new, path, ["k"], "t").count() == 0
    assert spark.read.parquet(path).count() == 5


def test_symbol_csv_and_lines(spark, tmp_path):
    b = spark.createDataFrame([("A B", "NSE", "1m", 1767584700, 1.0, 2.0, 0.5, 1.5, 7, 0)], S)
    archive.export_symbol_csv(b, str(tmp_path / "x"))
    r = spark.read.csv(str(tmp_path / "x"), header=True).first()
    assert (r.DATE, r.TIME, r.TICKER, r.VOLUME) == ("20260105", "09:15:00", "A B", "7")
    assert archive.csv_text(b.select("symbol", "close")).first().line == "A B,1.5"
    assert archive.csv_text(spark.createDataFrame([('x,"y', None)], "a string, b int")).first().line == '"x,\\"y",'


def test_one_series_at_any_interval(spark):
    o = 1767584700
    b = spark.createDataFrame([("A", "NSE", "1m", o + 60 * i, 1.0 + i, 9.0 + i, 0.5, 1.5 + i, 10, 0) for i in range(7)] + [("B", "NSE", "1m", o, 1.0, 1.0, 1.0, 1.0, 1, 0)], S)
    got = [(r.timestamp - o, r.open, r.close, r.volume) for r in resample.get_ohlcv(b, "a", "NSE", "5m", o, o + 600).orderBy("timestamp").collect()]
    assert got == [(0, 1.0, 5.5, 50), (300, 6.0, 7.5, 20)]
    assert resample.get_ohlcv(b, "a", "NSE", "5m", o + 300, o + 600).count() == 1 and resample.get_ohlcv(b, "a", "BSE", "5m", 0, 2**40).count() == 0


def test_limits_of_literal_lists(spark):
    b = spark.createDataFrame([], S)
    with pytest.raises(ValueError):
        archive.read_many(b, [(str(i), "A", "NSE", "1m", 0, 1) for i in range(17)])
    ids = archive.next_ids(spark.createDataFrame([("b",), ("a",), (None,), ("abcd",), ("abce",)], "n string"), spark.createDataFrame([(10,)], "m int"), "n")
    assert {r.n: r.id for r in ids.collect()} == {None: 11, "a": 12, "abcd": 13, "abce": 14, "b": 15}


def test_the_clock_closes_the_last_bar(spark):
    from quillbar.streaming import bars as live

    t = spark.createDataFrame([("s", 1, 10.0, 1.0, 5.0), ("s", 2, 70.0, 2.0, 8.0), ("s", 3, 75.0, 3.0, 9.0), ("t", 1, 5.0, 1.0, 1.0)], "symbol string, seq bigint, ts double, price double, volume double")
    at = lambda clock: [(r.symbol, r.bucket, r.close, r.volume, r.ticks) for r in live.closing_bars_batch(t, 60, clock).collect()]
    assert at(None) == [] and at(120.1) == []  # the settling time has not passed
    assert at(120.2) == [("s", 60, 3.0, 4.0, 2)]
    assert live.closing_bars_batch(t.where("false"), 60, 1e9).count() == 0
