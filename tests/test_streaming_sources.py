from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quillbar.sources import connectors as cn
from quillbar.streaming import bars as live


def test_bar_rule():
    b = live.BarState(60)
    assert b.tick(5, 10.0, 100) is None and b.tick(50, 12.0, 130) is None
    assert b.tick(61, 11.0, 140) is None  # the first bucket was not watched from its opening
    assert b.tick(59, 99.0, 1) is None  # late
    assert b.tick(119, 13.0, 170) is None
    assert b.tick(130, 9.0, 180) == (60, 11.0, 13.0, 11.0, 13.0, 40, 2)
    assert b.clock(179.9) is None
    assert b.clock(180.3) == (120, 9.0, 9.0, 9.0, 9.0, 10, 1)
    assert b.tick(179, 5.0, 181) is None and b.clock(500) is None
    assert b.tick(181, 7.0, 200) is None and b.tick(300, 8.0, 210) == (180, 7.0, 7.0, 7.0, 7.0, 20, 1)


def test_closing_bars_batch_against_rule(spark):
    rows = [("A", i, float(i * 17 % 400 + i * 9), 10.0 + i % 5, float(i)) for i in range(300)] + [("B", 0, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "symbol string, seq bigint, ts double, price double, volume double")
    rule, want = live.BarState(60), []
    for _, _, t, p, c in rows[:300]:
        if x := rule.tick(t, p, c):
            want.append(("A", *x))
    assert [tuple(r) for r in live.closing_bars_batch(df, 60).orderBy("bucket").collect()] == want


def test_windowed_stream_equals_batch(spark, tmp_path):
    df = spark.range(2000).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("symbol"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("at"), (F.col("id") % 11 + 1.0).alias("price"), F.lit(1).alias("size"), F.col("id").alias("seq"))
    df.repartition(4).write.parquet(str(tmp_path / "t.parquet"))
    st = live.stream_table(spark, str(tmp_path), "t", df.schema)
    out = live.run_available(live.windowed_bars(st, "1 minute", "30 seconds"), str(tmp_path / "run"))
    want = df.groupBy("symbol", (F.floor(F.unix_seconds("at") / 60) * 60).alias("bucket")).agg(F.min_by("price", "seq").alias("open"), F.max_by("price", "seq").alias("close"), F.count("*").alias("n"))
    a = {(r.symbol, r.bucket): (r.open, r.close, r.n) for r in out.collect()}
    b = {(r.symbol, r.bucket): (r.open, r.close, r.n) for r in want.collect()}
    last = max(k[1] for k in b)
    assert a == {k: v for k, v in b.items() if k in a} and all(k in a for k in b if k[1] < last - 120)


def test_clean_ticks(spark):
    df = spark.createDataFrame([("A", "1700000000", "5", "1"), ("A", "1700000000500", "5", None), ("A", "x", "5", "1"), ("A", "1700000000", "-1", "1"), ("A", "1700000000", None, "1"), (None, "1700000000", "5", "1")], "symbol string, ts string, price string, volume string")
    assert [r.at.microsecond for r in live.clean_ticks(df).orderBy("at").collect()] == [0, 500000]


def test_signal_files(spark):
    raw = spark.createDataFrame([("05-01-2026", "aaa", 2), ("2026-01-05", "AAA", 3), ("2026-01-06", " BBB", 4), ("2026-13-05", "C", 5), ("2026-01-05", "bad symbol!", 6), (None, "A", 7)], "`﻿Signal Date` string, Ticker string, row int")
    good, bad = cn.signals(raw)
    assert sorted((r.symbol, str(r.signal_date), r.row) for r in good.collect()) == [("AAA", "2026-01-05", 2), ("BBB", "2026-01-06", 4)]
    assert {r.row: r.reason for r in bad.collect()} == {5: "date", 6: "symbol", 7: "date"}
    with pytest.raises(ValueError):
        cn.resolve_header(["Date", "Scan Date", "Symbol"])
    with pytest.raises(ValueError):
        cn.resolve_header(["Time", "Symbol"])
    assert cn.resolve_header(["Datetime", "Signal Time", "NSE Symbol", "Industry", "Instrument Type"]) == {"timestamp": "Datetime", "time": "Signal Time", "symbol": "NSE Symbol", "sector": "Industry", "asset_class": "Instrument Type"}
    stamped = spark.createDataFrame([("2026-01-05T20:00:00Z", "AAA", 1), ("2026-01-05T20:00:00", "BBB", 2), ("soon", "CCC", 3)], "Timestamp string, Symbol string, row int")
    good, bad = cn.signals(stamped)
    assert sorted((r.symbol, str(r.signal_date)) for r in good.collect()) == [("AAA", "2026-01-06"), ("BBB", "2026-01-05")] and [r.row for r in bad.collect()] == [3]


def fake_page(lo, hi):
    return [(t, 1.0, 2.0, 0.5, 1.5, 10) for t in range(lo - 60, hi + 60, 60)]


def test_paged_history(spark):
    df = cn.history(spark, "api", **{"from": "0", "to": "600", "page": "240", "fetch": "tests.test_streaming_sources:fake_page"})
    assert df.count() == 10 and df.agg(F.sum("oi")).first()[0] == 0
    with pytest.raises(ValueError):
        cn.history(spark, "other")
    with pytest.raises(ValueError):
        cn.check_history(df.drop("close"))


def test_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("aaa\n bbb,x\n\n")
    assert sorted(r.symbol for r in cn.symbol_list(spark, str(tmp_path / "s.csv")).collect()) == ["AAA", "BBB"]
    (tmp_path / "d.csv").write_text("token,lot\n7,50\nx,y\n")
    assert [r.lot for r in cn.instrument_dump(spark, str(tmp_path / "d.csv"), "token string, lot int").collect()] == [50, None]
    assert cn.weekdays(spark, "2026-01-01", "2026-01-31", ["2026-01-26"], ["2026-01-25"]).count() == 22
    a, b = (cn.sine_bars(spark, ["AAA"], "2026-01-01", 30).collect() for _ in range(2))
    assert a == b and all(r.low <= r.close <= r.high for r in a)


def test_closing_bars_with_state(spark, tmp_path):
    """The stateful stream gives the bars of the rule, over several micro-batches.
    With timers by the clock the stream never comes to rest, so it is stopped
    once its bars are there."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("A", float(4_000_000_000 + i * 11), i, 10.0 + i % 5, float(i)) for i in range(60)]
    schema = "symbol string, ts double, seq bigint, price double, volume double"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / "t.parquet"), mode="append")
        time.sleep(1.1)
    rule = live.BarState(60)
    want = [("A", *x) for _, t, _, p, v in rows if (x := rule.tick(t, p, v))]
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t.parquet"))
    q = live.closing_bars(src, 60).writeStream.format("memory").queryName("closing").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            time.sleep(1)
            got = sorted(tuple(r) for r in spark.sql("select * from closing").collect())
            if q.exception() or len(got) >= len(want):
                break
    finally:
        q.stop()
    assert got == want and len(want) > 5
