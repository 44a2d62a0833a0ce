from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillbar.operators import references as ref

T = lambda h: dt.datetime(2026, 1, 5, h, tzinfo=dt.timezone.utc)


def _tables(spark, jobs=None, items=None, inst=None, orders=None, loaded=None):
    return ref.market_orphans(
        spark.createDataFrame(jobs or [], "id string, created_at timestamp, key string"),
        spark.createDataFrame(items or [], "id bigint, job_id string, started_at timestamp, salt int"),
        spark.createDataFrame(inst or [], "id bigint, exchange string, symbol string, token string, snapshot_date date"),
        spark.createDataFrame(orders or [], "id bigint, exchange string, symbol string, order_timestamp timestamp"),
        spark.createDataFrame(loaded or [], "token string, file_date date"),
    )


def _ids(df):
    return sorted((r.ref_table, r.ref_id) for r in df.select("ref_table", "ref_id").distinct().collect())


def test_jobs_by_time_and_spelling(spark):
    jobs = [("A", T(3), "x"), ("a ", T(2), "x"), ("B", None, "x"), ("C", T(9), "x")]
    items = [(1, " a", T(2), 0), (2, "A", T(1), 0), (3, "b", T(1), 0), (4, "zz", T(1), 0), (5, None, T(1), 0), (6, "  ", T(1), 0), (7, "C", None, 0), (8, "ghost", None, 0), (4, "zz", T(1), 0)]
    assert _ids(_tables(spark, jobs, items)) == [("job_items", 2), ("job_items", 4), ("job_items", 8)]


def test_orders_meet_the_snapshot_in_force(spark):
    d = dt.date
    inst = [(1, "NSE", "AAA", "1", d(2026, 1, 1)), (2, "NSE", "BBB", "2", d(2026, 1, 8))]
    at = lambda day: dt.datetime(2026, 1, day, 12, tzinfo=dt.timezone.utc)
    orders = [(1, "NSE", "aaa ", at(3)), (2, "NSE", "BBB", at(3)), (3, "NSE", "AAA", at(9)), (4, "nse", "bbb", at(8)), (5, "NSE", None, at(3)), (6, "NSE", "AAA", dt.datetime(2025, 12, 31, tzinfo=dt.timezone.utc)), (7, "NSE", "BBB", None), (8, "NSE", "CCC", None)]
    got = [i for t, i in _ids(_tables(spark, inst=inst, orders=orders)) if t == "sandbox_orders"]
    assert got == [2, 3, 6, 8]


def test_tokens_need_a_loaded_record_in_time(spark):
    d = dt.date
    inst = [(1, "CDS", "X", " 7 ", d(2026, 1, 1)), (2, "CDS", "X", "7", d(2025, 12, 1)), (3, "CDS", "X", "8", d(2026, 1, 1)), (4, "NSE", "X", "9", d(2026, 1, 1)), (5, "CDS", "X", None, d(2026, 1, 1))]
    got = _ids(_tables(spark, inst=inst, loaded=[("7", d(2025, 12, 31)), ("7", d(2026, 2, 1))]))
    assert got == [("symtoken", 2), ("symtoken", 3)]


def test_hot_key_and_report(spark):
    items = [(i, "ghost" if i % 3 else "A", T(5), 0) for i in range(3000)]
    o = _tables(spark, [("A", T(1), "x")], items)
    assert o.count() == 2000
    r = ref.orphan_report(o).collect()
    assert [(x.ref_table, x.period, x.orphans, x.missing_keys) for x in r] == [("job_items", "2026-01", 2000, 1)]


def test_empty_tables(spark):
    assert _tables(spark).count() == 0
    assert _ids(_tables(spark, items=[(1, "A", T(1), 0)])) == [("job_items", 1)]
    assert _tables(spark).select(F.col("parent_table")).columns == ["parent_table"]
