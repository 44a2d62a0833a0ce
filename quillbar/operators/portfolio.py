"""Portfolio simulation, metrics, attribution, clusters, rotation, benchmarks.

Series are long (symbol, day, close). Weights are rows (symbol, weight)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbar.operators.series import by, longest_runs, returns, upto, weighted_mean
from quillbar.session import cut_lineage

YEAR = 252


def normalise_weights(weights: DataFrame) -> DataFrame:
    """Shares of the total; negative or missing weights and a total of nothing are errors."""
    total = weights.agg(F.sum("weight")).scalar()
    bad = F.col("weight").isNull() | (F.col("weight") < 0) | F.isnan("weight") | (total <= 0)
    return weights.select("symbol", F.when(bad, F.raise_error(F.lit("weights must be finite, not negative and not all zero")).cast("double")).otherwise(F.col("weight") / total).alias("weight"))


def buy_and_hold(long: DataFrame, weights: DataFrame, capital: float) -> DataFrame:
    """Value per day of sleeves that drift: weight * capital * close / first close."""
    first = F.first("close").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    j = long.withColumn("_f", first).join(normalise_weights(weights), "symbol")
    return j.groupBy("day").agg((F.sum(F.col("weight") * F.col("close") / F.col("_f")) * capital).alias("value"), F.count("*").alias("members"))


def calendar_rebalanced(long: DataFrame, weights: DataFrame, capital: float, period: str = "month") -> DataFrame:
    """Value per day when sleeves are set back to target at each period's last
    session, without costs. Within a period sleeves drift; the factor of a period
    is the weighted growth of its sleeves, and values chain by a running product."""
    w = normalise_weights(weights)
    base = F.lag("close").over(by())
    p = F.trunc("day", period)
    d = long.withColumn("p", p).withColumn("_b", base)
    # sleeves start each period from the last close of the period before
    start = F.first(F.coalesce("_b", "close")).over(Window.partitionBy("symbol", "p").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    g = d.withColumn("_s", start).join(w, "symbol").groupBy("day", "p").agg(F.sum(F.col("weight") * F.col("close") / F.col("_s")).alias("g"))
    last = g.groupBy("p").agg(F.max_by("g", "day").alias("full"))
    chain = last.select("p", F.coalesce(F.sum(F.log("full")).over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_l"))
    return g.join(chain, "p").select("day", (F.lit(capital) * F.exp("_l") * F.col("g")).alias("value"))


def simulate(long: DataFrame, scenarios: DataFrame) -> DataFrame:
    """General rebalancing with costs and drift bands, one scenario per group.

    ``scenarios``: scenario, symbol, weight, rule (none, month, quarter, year,
    band), band, cost_rate, capital. Output per scenario and day: value, gross
    value (without costs), cost, turnover, orders. A rebalancing day trades half
    the sum of the weight changes each way; costs are charged on the traded
    value and taken from the sleeves in proportion. A scenario holds one value per
    symbol and session, which bounds its group."""
    every = long.join(scenarios, "symbol")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["day", "symbol"], kind="stable")
        m = g.pivot(index="day", columns="symbol", values="close").dropna()
        one = g.drop_duplicates("symbol").set_index("symbol").loc[m.columns]
        target = (one["weight"] / one["weight"].sum()).to_numpy()
        rule, band, rate, capital = one["rule"].iloc[0], float(one["band"].iloc[0] or 0), float(one["cost_rate"].iloc[0]), float(one["capital"].iloc[0])
        days = pd.to_datetime(pd.Series(m.index))
        key = {"month": days.dt.to_period("M"), "quarter": days.dt.to_period("Q"), "year": days.dt.to_period("Y")}.get(rule)
        due = np.zeros(len(m), bool) if key is None else np.append((key.to_numpy()[1:] != key.to_numpy()[:-1]), True)
        x = m.to_numpy()
        net, gross = target * capital, target * capital
        out = []
        for i in range(len(x)):
            if i:
                r = x[i] / x[i - 1]
                net, gross = net * r, gross * r
            cost = turn = 0.0
            orders = 0
            v = net.sum()
            if i and (due[i] or (rule == "band" and np.abs(net / v - target).max() > band)):
                delta = target * v - net
                turn = np.abs(delta).sum() / 2 / v
                orders = int((np.abs(delta) > 1e-9).sum())
                cost = np.abs(delta).sum() * rate
                net = target * (v - cost)
                gross = target * gross.sum()
            out.append((net.sum(), gross.sum(), cost, turn, orders))
        r = pd.DataFrame(out, columns=["value", "gross", "cost", "turnover", "orders"])
        r.insert(0, "day", list(m.index))
        r.insert(0, "scenario", g["scenario"].iloc[0])
        return r

    return every.groupBy("scenario").applyInPandas(run, "scenario string, day date, value double, gross double, cost double, turnover double, orders int")


def moments(x: Column) -> dict[str, Column]:
    """Sample-corrected skewness and excess kurtosis from population ones."""
    n = F.count(x).cast("double")
    return {
        "skew": F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)),
        "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)),
    }


def metrics(ret: DataFrame, key: str = "symbol") -> DataFrame:
    """Return and risk figures per key from daily returns (252 days, no risk-free
    rate): value at risk and its expected shortfall at 5 %, tail ratio as the 95th
    percentile against the 5th, ulcer index over the whole path."""
    w = Window.partitionBy(key).orderBy("day")
    d = ret.withColumn("_c", F.exp(F.sum(F.log1p("ret")).over(upto(w))))
    d = d.withColumn("_dd", F.col("_c") / F.greatest(F.lit(1.0), F.max("_c").over(upto(w))) - 1)
    d = d.join(ret.groupBy(key).agg(F.percentile("ret", F.lit(0.05)).alias("_q5")), key)
    r = F.col("ret")
    n = F.count("*")
    down = F.sqrt(F.avg(F.when(r < 0, r * r).otherwise(0.0)))
    g = d.groupBy(key).agg(
        n.alias("n"), (F.exp(F.sum(F.log1p(r)) * YEAR / n) - 1).alias("cagr"), (F.stddev_samp(r) * math.sqrt(YEAR)).alias("volatility"),
        (F.avg(r) / F.stddev_samp(r) * math.sqrt(YEAR)).alias("sharpe"), (F.avg(r) / down * math.sqrt(YEAR)).alias("sortino"), F.min("_dd").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("win_rate"), F.max(r).alias("best"), F.min(r).alias("worst"), F.max("_q5").alias("var_95"),
        F.avg(F.when(r <= F.col("_q5"), r)).alias("cvar_95"), F.sqrt(F.avg(F.col("_dd") * F.col("_dd"))).alias("ulcer"),
        (F.percentile(r, F.lit(0.95)) / F.abs(F.percentile(r, F.lit(0.05)))).alias("tail_ratio"), *[c.alias(k) for k, c in moments(r).items()],
    )
    return g.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / -F.col("max_drawdown")))


def benchmark(ret: DataFrame, bench: DataFrame, key: str = "symbol") -> DataFrame:
    """Excess return, beta, alpha, correlation, tracking error and information ratio on shared days."""
    j = ret.join(bench.select("day", F.col("ret").alias("b")), "day")
    x = F.col("ret") - F.col("b")
    beta = F.covar_samp("ret", "b") / F.var_samp("b")
    te = F.stddev_samp(x)
    return j.groupBy(key).agg(
        F.count("*").alias("n"), beta.alias("beta"), ((F.avg("ret") - beta * F.avg("b")) * YEAR).alias("alpha"), F.corr("ret", "b").alias("corr"),
        (te * math.sqrt(YEAR)).alias("tracking_error"), (F.avg(x) / te * math.sqrt(YEAR)).alias("information_ratio"),
    )


def common_run(long: DataFrame, bench: DataFrame, sessions: DataFrame) -> DataFrame:
    """Longest run of sessions on which both the series and the benchmark have a value."""
    spine = sessions.select("day").distinct()
    seen = long.select("symbol", "day").join(bench.select("day").distinct(), "day", "left_semi").withColumn("_h", F.lit(1))
    span = long.groupBy("symbol").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = spine.agg(F.sort_array(F.collect_list("day"))).scalar()
    grid = span.select("symbol", F.explode(F.filter(days, lambda d: d.between(F.col("lo"), F.col("hi")))).alias("day"))
    return longest_runs(grid.join(seen, ["symbol", "day"], "left"), F.col("_h").isNotNull())


def attribution(ret: DataFrame, weights: DataFrame, bench: DataFrame) -> DataFrame:
    """Contribution per holding: yesterday's drifted weight times today's return,
    split into what the benchmark also made (allocation) and the rest (selection)."""
    w0 = normalise_weights(weights)
    c = ret.withColumn("_g", F.exp(F.sum(F.log1p("ret")).over(upto(by()))))
    d = c.join(w0, "symbol").withColumn("_v", F.col("weight") * F.coalesce(F.lag("_g").over(by()), F.lit(1.0)))
    d = d.withColumn("w", F.col("_v") / F.sum("_v").over(Window.partitionBy("day")))
    j = d.join(bench.select("day", F.col("ret").alias("b")), "day")
    return j.groupBy("symbol").agg(F.sum(F.col("w") * F.col("ret")).alias("contribution"), F.sum(F.col("w") * F.col("b")).alias("allocation"), F.sum(F.col("w") * (F.col("ret") - F.col("b"))).alias("selection"))


def clusters(pairs: DataFrame, members: DataFrame, least: float = 0.6) -> DataFrame:
    """Groups joined by a correlation of at least ``least`` (single linkage):
    labels flow along links, each member taking the least label around it, until
    no label changes. Links and labels are written to the checkpoint folder, so
    a round costs one small join and no recomputation."""
    e = pairs.where(F.col("corr") >= least).select("a", "b")
    both = cut_lineage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    lab = members.select(F.col("symbol").alias("a"), F.col("symbol").alias("label"))
    while True:
        near = both.join(lab.select(F.col("a").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        new = cut_lineage(lab.join(near, "a", "left").select("a", F.least("label", F.coalesce("other", "label")).alias("label"), (F.col("other") < F.col("label")).alias("moved")))
        lab = new.select("a", "label")
        if new.where("moved").isEmpty():
            return lab.select(F.col("a").alias("symbol"), F.col("label").alias("cluster"))


def inverse_volatility(ret: DataFrame, groups: DataFrame, window: int = 60) -> DataFrame:
    """Equal budget per cluster, inside a cluster by inverse volatility of the last ``window`` returns."""
    w = Window.partitionBy("symbol").orderBy(F.desc("day"))
    v = ret.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= window).groupBy("symbol").agg(F.stddev_samp("ret").alias("sd"))
    j = v.join(groups, "symbol").withColumn("_i", 1 / F.col("sd"))
    k = groups.agg(F.count_distinct("cluster")).scalar()
    return j.select("symbol", "cluster", (F.col("_i") / F.sum("_i").over(Window.partitionBy("cluster")) / k).alias("weight"))


def restrict_weights(weights: DataFrame, active: DataFrame) -> DataFrame:
    return normalise_weights(weights.join(active, "symbol", "left_semi"))


def drift_test(current: DataFrame, target: DataFrame, band: float) -> DataFrame:
    j = current.join(target.select("symbol", F.col("weight").alias("t")), "symbol", "full_outer")
    d = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("t", F.lit(0.0)))
    return j.agg(F.max(d).alias("drift"), (F.max(d) > band).alias("rebalance"))


def rotation(long: DataFrame, bench: DataFrame, fast: int = 14, slow: int = 36, momentum: int = 8) -> DataFrame:
    """Relative strength against the benchmark, its smoothed ratio and momentum, and the quadrant."""
    j = long.join(bench.select("day", F.col("close").alias("b")), "day").withColumn("rs", F.col("close") / F.col("b") * 100)
    r = j.withColumn("ratio", weighted_mean("rs", fast, by()) / weighted_mean("rs", slow, by()) * 100)
    r = r.withColumn("momentum", F.col("ratio") / F.lag("ratio", momentum).over(by()) * 100)
    up, hot = F.col("ratio") >= 100, F.col("momentum") >= 100
    q = F.when(up & hot, "leading").when(up, "weakening").when(hot, "improving").otherwise("lagging")
    return r.where("momentum is not null").select("symbol", "day", "ratio", "momentum", q.alias("quadrant"))


def health(values: DataFrame, scales: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Pillar scores from linear scales (worst, best, weight), the weighted mean
    over the pillars that have a value, and the grade."""
    out, num, den = values, F.lit(0.0), F.lit(0.0)
    for c, (worst, best, weight) in scales.items():
        s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col(c) - worst) / (best - worst) * 100))
        out = out.withColumn(f"{c}_score", s)
        num = num + F.coalesce(F.col(f"{c}_score") * weight, F.lit(0.0))
        den = den + F.when(F.col(c).isNotNull(), weight).otherwise(0.0)
    out = out.withColumn("score", F.when(den > 0, num / den))
    x = F.col("score")
    return out.withColumn("grade", F.when(x >= 80, "A").when(x >= 65, "B").when(x >= 50, "C").when(x >= 35, "D").when(x.isNotNull(), "F"))


def findings(values: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Names of the threshold rules (name, SQL condition) that hold per row."""
    hit = [F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules]
    return values.select("symbol", F.explode(F.array_compact(F.array(*hit))).alias("finding"))


def bootstrap(ret: DataFrame, paths: int = 1000, block: int = 20, seed: int = 12345, horizon: int = 252) -> DataFrame:
    """Block bootstrap of one return series: total return and deepest drawdown
    per path. Paths are spread over tasks; each draws from its own generator,
    seeded by path, so the result does not depend on the layout. The series is
    one value per session of one portfolio and goes along with every task."""
    series = [r.ret for r in ret.orderBy("day").select("ret").collect()]
    x = np.array(series, dtype=float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["id"]:
                rng = np.random.default_rng([seed, int(p)])
                n = -(-horizon // block)
                at = rng.integers(0, max(1, len(x) - block + 1), n)
                r = np.concatenate([x[a : a + block] for a in at])[:horizon]
                c = np.cumprod(1 + r)
                out.append((int(p), float(c[-1] - 1), float((c / np.maximum.accumulate(np.maximum(c, 1.0)) - 1).min())))
            yield pd.DataFrame(out, columns=["path", "total_return", "max_drawdown"])

    return ret.sparkSession.range(paths).mapInPandas(run, "path bigint, total_return double, max_drawdown double")
