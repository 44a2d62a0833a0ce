"""Signals traded from one account of cash, session by session.

Per account: a signal is entered at the open of the first session after it, in
the order of the file, with whole shares as the cash allows. In every session
first the openings beyond a stop or target exit at the open, then entries use the
cash (with what these exits brought), then the session's range is tested, the
stop before the target, then the holding time ends at the close. A trailing
stop follows the highest price of completed sessions only. A position whose bar
is missing in a session is never closed afterwards, since its exit could have
been there: it stays pending and is marked at the closes there are.

Scale: funding is sequential within an account, so an account is one group:
its signals and the bars of its symbols. Accounts run side by side.

Defined results: a signal whose entry session has no bar, or that has no later
session, is pending without shares; one the cash cannot buy a share for is
skipped; equal signals are separate; nulls in date or symbol are no signal; an
account without signals has no rows; empty tables give none.
"""

from __future__ import annotations

import bisect
import datetime as dt
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER = (
    "account string, priority bigint, symbol string, signal_date date, entry_date date, quantity bigint, entry_price double, "
    "exit_date date, exit_raw double, exit_price double, outcome string, exit_at string, fees double, pnl double, status string"
)
CURVE = "account string, day date, cash double, equity double"


@dataclass
class Rules:
    """Percentages of price; costs and slippage in basis points; ``per_trade``: cash a trade may use (all there is if None)."""

    capital: float = 100_000.0
    per_trade: float | None = None
    stop_pct: float = 5.0
    target_pct: float = 10.0
    trailing_pct: float | None = None
    hold_sessions: int = 20
    cost_bps: float = 0.0
    slippage_bps: float = 0.0


@dataclass
class Trade:
    row: dict
    shares: int = 0
    entered: int = 0
    stop: float = 0.0
    target: float = 0.0
    highest: float = 0.0
    trailed: bool = False
    mark: float = 0.0
    lost: bool = False
    out: bool = False
    paid: float = 0.0


def run_account(signals: list[tuple[int, dt.date, str]], bars: dict[str, dict[dt.date, tuple[float, float, float, float]]], sessions: list[dt.date], rules: Rules) -> tuple[list[dict], list[tuple[dt.date, float, float]]]:
    """(ledger, equity curve) of one account. ``signals``: (priority, date, symbol) in order of priority."""
    cost, slip = rules.cost_bps / 1e4, rules.slippage_bps / 1e4
    ledger: list[dict] = []
    due: dict[int, list[Trade]] = {}
    for priority, day, symbol in signals:
        at = bisect.bisect_right(sessions, day)
        row = {"priority": priority, "symbol": symbol, "signal_date": day, "entry_date": sessions[at] if at < len(sessions) else None, "quantity": 0, "fees": 0.0, "status": "pending"}
        ledger.append(row)
        if at < len(sessions):
            due.setdefault(at, []).append(Trade(row))
    cash = rules.capital
    held: list[Trade] = []
    curve: list[tuple[dt.date, float, float]] = []

    def close(t: Trade, raw: float, why: str, when: str, day: dt.date) -> None:
        nonlocal cash
        price = raw * (1 - slip)
        fee = t.shares * price * cost
        cash += t.shares * price - fee
        t.out = True
        t.row.update(exit_date=day, exit_raw=raw, exit_price=price, outcome=why, exit_at=when, fees=t.row["fees"] + fee, pnl=t.shares * price - fee - t.paid, status="closed")

    for n, day in enumerate(sessions):
        bar = lambda t: bars.get(t.row["symbol"], {}).get(day)
        for t in held:
            b = bar(t)
            if b is None:
                t.lost = True
            elif not t.lost and b[0] <= t.stop:
                close(t, b[0], "trailing_stop" if t.trailed else "stop", "open", day)
            elif not t.lost and b[0] >= t.target:
                close(t, b[0], "target", "open", day)
        held = [t for t in held if not t.out]
        for t in due.get(n, []):
            b = bar(t)
            if b is None:
                continue
            price = b[0] * (1 + slip)
            shares = math.floor(min(cash, rules.per_trade or cash) / (price * (1 + cost)) + 1e-9)
            if shares < 1:
                t.row["status"] = "skipped"
                continue
            fee = shares * price * cost
            t.shares, t.entered, t.paid, t.highest, t.mark = shares, n, shares * price + fee, 0.0, b[0]
            t.stop, t.target = round(price * (1 - rules.stop_pct / 100), 2), round(price * (1 + rules.target_pct / 100), 2)
            cash -= t.paid
            t.row.update(quantity=shares, entry_price=price, fees=fee, status="open")
            held.append(t)
        for t in held:
            b = bar(t)
            if b is None:
                continue
            t.mark = b[3]
            if t.lost:
                continue
            if b[2] <= t.stop:
                close(t, t.stop, "trailing_stop" if t.trailed else "stop", "session", day)
            elif b[1] >= t.target:
                close(t, t.target, "target", "session", day)
            elif n - t.entered >= rules.hold_sessions:
                close(t, b[3], "hold", "close", day)
            elif rules.trailing_pct is not None:  # for the next session
                t.highest = max(t.highest, b[1])
                wish = round(t.highest * (1 - rules.trailing_pct / 100), 2)
                if wish > t.stop:
                    t.stop, t.trailed = wish, True
        held = [t for t in held if not t.out]
        curve.append((day, cash, cash + sum(t.shares * t.mark for t in held)))
    for t in held:
        t.row["status"] = "pending"
    return ledger, curve


def _groups(signals: DataFrame, bars: DataFrame, days: list[dt.date], rules: Rules, want: str, schema: str) -> DataFrame:
    s = signals.select("account", "priority", "signal_date", "symbol").where("account is not null and signal_date is not null and symbol is not null")
    mine = bars.select("symbol", "day", "open", "high", "low", "close").join(s.select(F.col("account").alias("of"), "symbol").distinct(), "symbol")
    cols = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, sig: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if sig.empty:
            return pd.DataFrame({c: [] for c in cols})
        prices: dict[str, dict[dt.date, tuple]] = {}
        for symbol, day, *ohlc in b[["symbol", "day", "open", "high", "low", "close"]].itertuples(index=False, name=None):
            prices.setdefault(symbol, {})[day] = tuple(ohlc)
        sig = sig.sort_values(["priority", "symbol"], kind="stable")
        ledger, curve = run_account(list(sig[["priority", "signal_date", "symbol"]].itertuples(index=False, name=None)), prices, days, rules)
        rows = ledger if want == "ledger" else [{"day": d, "cash": c, "equity": e} for d, c, e in curve]
        out = pd.DataFrame([{"account": key[0], **r} for r in rows]).reindex(columns=cols)
        return out.astype(object).where(out.notna(), None)

    return s.groupBy("account").cogroup(mine.groupBy("of")).applyInPandas(run, schema)


def ledger(signals: DataFrame, bars: DataFrame, sessions: list[dt.date], rules: Rules) -> DataFrame:
    """One row per signal (account, priority, signal_date, symbol): what became of
    it. ``bars``: symbol, day, open, high, low, close; ``sessions``: the calendar."""
    return _groups(signals, bars, sorted(sessions), rules, "ledger", LEDGER)


def equity_curve(signals: DataFrame, bars: DataFrame, sessions: list[dt.date], rules: Rules) -> DataFrame:
    """Cash and equity, marked at the close, of every account and session."""
    return _groups(signals, bars, sorted(sessions), rules, "curve", CURVE)
