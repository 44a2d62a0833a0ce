"""Outcomes of the account engine, by hand."""

from __future__ import annotations

import datetime as dt

import pytest

from quillbar.operators.accounts import Rules, equity_curve, ledger, run_account

DAYS = [dt.date(2026, 1, d) for d in (5, 6, 7, 8, 9, 12, 13, 14)]
FLAT = (100.0, 102.0, 98.0, 100.0)
K = dict(capital=1000.0, stop_pct=5.0, target_pct=10.0, hold_sessions=20)


def go(bars, signals=((0, DAYS[0], "A"),), **rules):
    b = {s: {DAYS[i]: x for i, x in v.items()} for s, v in bars.items()}
    return run_account(list(signals), b, DAYS, Rules(**{**K, **rules}))


def test_stop_before_target_in_the_next_session():
    rows, curve = go({"A": {0: (100, 200, 1, 100), 1: (100, 120, 90, 100)}})
    assert (rows[0]["entry_date"], rows[0]["outcome"], rows[0]["exit_price"], curve[-1][2]) == (DAYS[1], "stop", 95, 950)


@pytest.mark.parametrize(("opening", "why"), [(80, "stop"), (120, "target")])
def test_gaps_fill_at_the_open(opening, why):
    r = go({"A": {1: FLAT, 2: (opening, opening + 1, opening - 1, opening)}})[0][0]
    assert (r["exit_price"], r["outcome"], r["exit_at"]) == (opening, why, "open")


def test_hold_and_trailing():
    r = go({"A": {i: FLAT for i in range(8)}}, hold_sessions=5)[0][0]
    assert (r["exit_date"], r["outcome"]) == (dt.date(2026, 1, 13), "hold")
    r = go({"A": {1: (100, 120, 96, 115), 2: (113, 115, 110, 112)}}, target_pct=50, stop_pct=20, trailing_pct=5)[0][0]
    assert (r["exit_date"], r["exit_price"], r["outcome"]) == (DAYS[2], 113, "trailing_stop")


def test_a_missing_bar_leaves_the_trade_pending():
    rows, curve = go({"A": {1: FLAT, 3: (150, 155, 145, 150)}})
    assert (rows[0]["status"], rows[0]["quantity"], curve[-1][2]) == ("pending", 10, 1500)
    rows, curve = go({"A": {}}, [(0, DAYS[0], "A"), (1, DAYS[-1], "A")])
    assert [(r["status"], r["quantity"]) for r in rows] == [("pending", 0)] * 2 and rows[1]["entry_date"] is None and curve[-1][2] == 1000


def test_only_opening_exits_fund_entries():
    for bar, funded in (((120, 125, 115, 120), True), ((100, 120, 98, 115), False)):
        rows, _ = go({"A": {1: FLAT, 2: bar}, "B": {2: FLAT}}, [(0, DAYS[0], "A"), (1, DAYS[1], "B")])
        assert (rows[1]["quantity"] > 0) == funded and (funded or rows[1]["status"] == "skipped")


def test_costs_slippage_and_marks():
    rows, curve = go({"A": {1: FLAT, 2: FLAT}}, hold_sessions=1, cost_bps=100, slippage_bps=100)
    r = rows[0]
    assert r["quantity"] == 9 and r["fees"] == pytest.approx(18) and r["pnl"] == pytest.approx(-36)
    assert curve[-1][2] == pytest.approx(964) and curve[1][2] == pytest.approx(981.91)
    r = go({"A": {1: (33.33, 36, 33, 35)}}, cost_bps=10, slippage_bps=10, target_pct=5.1)[0][0]
    assert r["entry_price"] == pytest.approx(33.36333) and r["exit_raw"] == 35.06 and r["exit_price"] == pytest.approx(35.02494)


def test_priority_and_accounts(spark):
    bars = {"A": {1: (100, 120, 98, 110)}, "B": {1: (100, 102, 80, 90)}}
    for order, equity in ((("A", "B"), 1100), (("B", "A"), 950)):
        rows, curve = go(bars, [(i, DAYS[0], s) for i, s in enumerate(order)])
        assert rows[1]["status"] == "skipped" and curve[-1][2] == equity
    b = spark.createDataFrame([(s, DAYS[i], *map(float, x), "k") for s, v in bars.items() for i, x in v.items()], "symbol string, day date, open double, high double, low double, close double, account string")
    sig = spark.createDataFrame([("x", 0, DAYS[0], "A"), ("x", 1, DAYS[0], "B"), ("y", 0, DAYS[0], "B"), ("y", 1, DAYS[0], "A"), ("z", 0, DAYS[0], "C"), ("z", 1, None, "A")], "account string, priority bigint, signal_date date, symbol string")
    got = {(r.account, r.symbol): (r.status, r.outcome, r.quantity) for r in ledger(sig, b, DAYS, Rules(**K)).collect()}
    assert got == {("x", "A"): ("closed", "target", 10), ("x", "B"): ("skipped", None, 0), ("y", "B"): ("closed", "stop", 10), ("y", "A"): ("skipped", None, 0), ("z", "C"): ("pending", None, 0)}
    last = {r.account: r.equity for r in equity_curve(sig, b, DAYS, Rules(**K)).where(f"day = date '{DAYS[-1]}'").collect()}
    assert last == {"x": 1100.0, "y": 950.0, "z": 1000.0}
    assert ledger(sig.where("false"), b, DAYS, Rules(**K)).count() == 0
