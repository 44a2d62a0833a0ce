"""Profit-and-loss books: activity, positions, holdings, costs, fills."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_activity(trades: DataFrame, capital: float) -> DataFrame:
    """Bought, sold, two-sided turnover, fills and fees per day, and turnover against the capital."""
    v = F.col("qty") * F.col("price")
    side = lambda s: F.sum(F.when(F.col("side") == s, v).otherwise(0.0))
    d = trades.groupBy("day").agg(side("BUY").alias("bought"), side("SELL").alias("sold"), F.count("*").alias("fills"), F.sum("fee").alias("fees"))
    return d.withColumn("turnover", F.col("bought") + F.col("sold")).withColumn("turnover_share", F.col("turnover") / capital)


def mark_to_market(positions: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Unrealised result per strategy; legs without a price are counted, not guessed."""
    j = positions.join(prices, keys, "left")
    return j.groupBy("strategy").agg(
        F.count("*").alias("legs"), F.sum(F.when(F.col("ltp").isNull(), 1).otherwise(0)).cast("bigint").alias("unpriced"),
        F.sum("qty").alias("open_qty"), F.sum(F.when(F.col("ltp").isNotNull(), (F.col("ltp") - F.col("price")) * F.col("qty")).otherwise(0.0)).alias("unrealized"),
    )


def holdings(positions: DataFrame) -> DataFrame:
    """Value, result and weight of each holding."""
    p = positions.withColumn("invested", F.col("qty") * F.col("price")).withColumn("current", F.col("qty") * F.col("ltp"))
    total = p.agg(F.sum("current")).scalar()
    return p.select("symbol", "invested", "current", (F.col("current") - F.col("invested")).alias("pnl"), ((F.col("current") / F.col("invested") - 1) * 100).alias("pnl_pct"), (F.col("current") / total).alias("weight"))


def parse_holdings(raw: DataFrame) -> DataFrame:
    """Holdings with textual numbers; a missing last price is recovered from the result."""
    n = lambda c: F.expr(f"try_cast(regexp_replace({c}, ',', '') as double)")
    h = raw.select("symbol", n("qty").alias("qty"), n("price").alias("price"), n("pnl").alias("pnl"), n("ltp").alias("ltp"))
    return h.withColumn("ltp", F.coalesce("ltp", F.when(F.col("qty") != 0, F.col("price") + F.col("pnl") / F.col("qty"))))


def trade_quality(trades: DataFrame, keys: list[str], pnl: str = "pnl", least: int = 30) -> DataFrame:
    """Profit factor, win rate and whether the sample is large enough."""
    x = F.col(pnl)
    win, loss = F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x < 0, -x).otherwise(0.0))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(loss > 0, win / loss).alias("profit_factor"), F.avg((x > 0).cast("double")).alias("win_rate"), (F.count("*") >= least).alias("adequate")
    )


#: A cost rule: name, basis (turnover, buy, sell, order), rate, cap per order or None, taxed.
CostRule = tuple[str, str, float, float | None, bool]


def costs(orders: DataFrame, rules: list[CostRule], tax_rate: float = 0.18, slippage: float = 0.0) -> DataFrame:
    """Cost lines per order (order_id, buy, sell): each rule's amount, the tax on
    the taxed lines, and slippage on what was traded. Rules are a short literal
    list and become columns; there is no join."""
    turnover = F.col("buy") + F.col("sell")
    base = {"turnover": turnover, "buy": F.col("buy"), "sell": F.col("sell")}
    out, taxed, every = orders, F.lit(0.0), F.lit(0.0)
    for name, basis, rate, cap, tax in rules:
        if basis == "order":
            amount = F.lit(float(rate)) if cap is None else F.least(F.lit(float(cap)), turnover * rate)
        else:
            amount = base[basis] * rate
        out = out.withColumn(name, amount)
        every = every + F.col(name)
        taxed = taxed + F.col(name) if tax else taxed
    out = out.withColumn("tax", taxed * tax_rate).withColumn("slippage", turnover * slippage)
    return out.withColumn("total_cost", every + F.col("tax") + F.col("slippage"))


def book_fills(fills: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Running position, average price and realised result after each fill
    (signed qty, price). A fill against the position realises the closed part at
    the average price; one that goes through zero opens the remainder at its own
    price. The recurrence runs as a stream over each key's sorted fills: a task
    holds one batch and the state of one key."""
    cols = [*keys, *order, "qty", "price"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, pos, avg, real = None, 0.0, 0.0, 0.0
        for b in batches:
            out = []
            ks = list(b[keys].itertuples(index=False, name=None))
            for k, q, p in zip(ks, b["qty"].tolist(), b["price"].tolist()):
                if k != who:
                    who, pos, avg, real = k, 0.0, 0.0, 0.0
                if pos == 0 or pos * q > 0:
                    avg = (avg * abs(pos) + p * abs(q)) / (abs(pos) + abs(q)) if q else avg
                    pos += q
                else:
                    closed = min(abs(pos), abs(q))
                    real += closed * (p - avg) * (1 if pos > 0 else -1)
                    rest = pos + q
                    if rest == 0:
                        avg = 0.0
                    elif rest * pos < 0:
                        avg = p
                    pos = rest
                out.append((pos, avg, real))
            res = b[[*keys, *order]].copy()
            res[["position", "average", "realized"]] = pd.DataFrame(out, index=res.index, columns=["position", "average", "realized"])
            yield res

    kinds = ", ".join(f"{c} {fills.schema[c].dataType.simpleString()}" for c in [*keys, *order])
    src = fills.select(*cols).where(" and ".join(f"{c} is not null" for c in cols))
    return src.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, position double, average double, realized double")


def legs_open_first(legs: DataFrame) -> DataFrame:
    """Legs of a strategy as one list, the open ones first, otherwise in order."""
    item = F.struct((F.col("qty") == 0).alias("flat"), "seq", "symbol", "qty")
    return legs.groupBy("strategy").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.symbol).alias("symbols"))


def status_counts(orders: DataFrame, status: str, keys: list[str]) -> DataFrame:
    k = lambda v: F.sum((F.col(status) == v).cast("int")).cast("bigint")
    return orders.groupBy(*keys).agg(F.count("*").alias("total"), k("open").alias("open"), k("complete").alias("completed"), k("rejected").alias("rejected"), k("cancelled").alias("cancelled"))


def weight_sums(positions: DataFrame, klass: str, weight: str) -> DataFrame:
    return positions.groupBy(klass).agg(F.sum(weight).alias("weight"))


def cohort_stats(trades: DataFrame, keys: list[str], pnl: str, day: str, least: int = 30, least_days: int = 20) -> DataFrame:
    """Per cohort: trades, dates, mean, win rate, sum, mean of the daily means,
    whether both halves of its dates were positive, and sufficiency."""
    d = trades.groupBy(*keys, day).agg(F.count("*").alias("_n"), F.sum(pnl).alias("_s"), F.sum((F.col(pnl) > 0).cast("int")).alias("_w"))
    w = Window.partitionBy(*keys).orderBy(day)
    d = d.withColumn("_r", F.row_number().over(w)).withColumn("_c", F.count("*").over(Window.partitionBy(*keys))).withColumn("_m", F.col("_s") / F.col("_n"))
    first = F.col("_r") <= F.floor(F.col("_c") / 2)
    return d.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count("*").alias("days"), (F.sum("_s") / F.sum("_n")).alias("mean"), (F.sum("_w") / F.sum("_n")).alias("win_rate"), F.sum("_s").alias("total"),
        F.avg("_m").alias("mean_of_days"), ((F.avg(F.when(first, F.col("_m"))) > 0) & (F.avg(F.when(~first, F.col("_m"))) > 0)).alias("both_halves_up"),
        ((F.sum("_n") >= least) & (F.count("*") >= least_days)).alias("sufficient"),
    )
