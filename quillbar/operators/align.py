"""Joins that time series need: alignment, as-of, range, nearest, grids, pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inner_align(long: DataFrame, key: str, at: str, members: int | None = None) -> DataFrame:
    """Rows of the sessions in which every member is present; no N-way join: the
    sessions with the full count are kept by one aggregation and a semi-join."""
    if members is None:
        want = long.agg(F.count_distinct(key)).scalar()
    else:
        want = F.lit(members)
    complete = long.groupBy(at).agg(F.count_distinct(key).alias("_n")).where(F.col("_n") == want).select(at)
    return long.join(complete, at, "left_semi")


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], strict: bool = True) -> DataFrame:
    """For each left row the latest right row before it (or at it, unless strict).

    Both sides are united and one window carries the last right row forward: one
    shuffle on the key and no range join. Ties at one instant are ordered by
    side, so strictness holds."""
    v = F.struct(F.col(at).alias("_at"), *values)
    r = right.select(key, at, F.lit(0 if not strict else 1).alias("_o"), v.alias("_v"))
    lt = left.withColumn("_o", F.lit(1 if not strict else 0))
    u = lt.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    side = 1 if not strict else 0
    out = u.withColumn("_m", F.last("_v", ignorenulls=True).over(w)).where(F.col("_o") == side)
    return out.select(*left.columns, F.col("_m._at").alias("matched_at"), *[F.col(f"_m.{c}").alias(f"asof_{c}") for c in values])


def asof_forward(left: DataFrame, right: DataFrame, key: str, at: str, limit: Column | None = None) -> DataFrame:
    """For each left row the first right instant at or after it, if within the limit."""
    r = right.select(key, at, F.lit(1).alias("_o"), F.col(at).alias("_t"))
    u = left.withColumn("_o", F.lit(0)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_o").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = u.withColumn("matched_at", F.first("_t", ignorenulls=True).over(w)).where("_o = 0").drop("_o", "_t")
    return out if limit is None else out.withColumn("matched_at", F.when(F.col("matched_at") <= limit, F.col("matched_at")))


def range_join(rows: DataFrame, windows: DataFrame, at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Rows within [lo, hi] of each window, by equality on bins of ``width``: a
    window is exploded over its bins, a row falls into one, so neither side is
    multiplied by the other."""
    bin_of = lambda c: F.floor(c / width)
    w = windows.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(lo)), bin_of(F.col(hi)))))
    r = rows.withColumn("_bin", bin_of(F.col(at)))
    return r.join(w, "_bin").where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("_bin")


def nearest(prices: DataFrame, strikes: DataFrame, key: str, price: str, strike: str, salts: int = 64) -> DataFrame:
    """Nearest listed strike per row, the lower one on ties; a price that is as
    far from all strikes (null, not finite, huge) takes the lowest. A price so
    large that rounding makes only some strikes equally far (1e18 with strikes ten
    apart) takes the nearest by value, where SQL takes the lowest of those.

    Each strike carries the one above it and the lowest; united with the prices,
    one running window hands every price the strikes around it. The lowest strike
    stands before all prices. Prices of a key are spread over ``salts`` groups
    with the strikes in each, so that one key is not one task."""
    up = Window.partitionBy(key).orderBy("_s")
    s = strikes.select(key, F.col(strike).cast("double").alias("_s")).where("_s is not null").distinct()
    s = s.select(key, F.when(F.lag("_s").over(up).isNotNull(), F.col("_s")).alias("_x"), F.struct(F.col("_s").alias("lo"), F.lead("_s").over(up).alias("hi"), F.first("_s").over(up).alias("least")).alias("_v"))
    s = s.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    p = prices.withColumn("_x", F.col(price).cast("double")).withColumn("_salt", F.pmod(F.xxhash64(*prices.columns), F.lit(salts)).cast("int"))
    u = p.withColumn("_o", F.lit(1)).unionByName(s.withColumn("_o", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key, "_salt").orderBy("_x", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = u.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_o = 1")
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c) - F.col("_x")).alias("far"), F.col(c).alias("strike")))
    return out.select(*prices.columns, F.least(far("_v.lo"), far("_v.hi"), far("_v.least"))["strike"].alias("nearest"))


def full_grid(long: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Every row key with every column key, null where there is no cell. Each
    side is a distinct list (strikes of a chain, expiries): the grid is the
    result's own size, built by exploding the column keys onto the row keys."""
    cols = long.agg(F.sort_array(F.collect_set(column))).scalar()
    grid = long.select(row).distinct().select(row, F.explode(cols).alias(column))
    return grid.join(long.select(row, column, value), [row, column], "left")


def all_legs(prices: DataFrame, legs: DataFrame, at: str) -> DataFrame:
    """Signed sum over legs of the instants at which every leg is priced."""
    j = prices.join(legs, "symbol")
    n = legs.agg(F.count("*")).scalar()
    return j.groupBy(at).agg(F.sum(F.col("sign") * F.col("close")).alias("premium"), F.count("*").alias("_n")).where(F.col("_n") == n).drop("_n")


def pairs(long: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Aligned values of every pair of members (first below second). Meant for
    the members of one portfolio; rows meet only within an instant."""
    a = long.select(F.col(key).alias("a"), at, F.col(value).alias("x"))
    b = long.select(F.col(key).alias("b"), at, F.col(value).alias("y"))
    return a.join(b, at).where("a < b")


def pair_correlations(long: DataFrame, key: str = "symbol", at: str = "day", value: str = "ret", least: int = 20) -> DataFrame:
    """Correlation per pair, null where fewer than ``least`` instants are shared."""
    p = pairs(long, key, at, value).groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"))
    return p.withColumn("corr", F.when(F.col("n") >= least, F.col("corr")))


def correlated_pairs(long: DataFrame, atleast: float, key: str = "symbol", at: str = "day", value: str = "ret", least: int = 20, members: int = 256) -> DataFrame:
    """The pairs of ``pair_correlations`` whose correlation is at least
    ``atleast``, for many members: members are hashed into blocks, every two
    blocks meet in one task as matrices over their days, and only links leave it."""
    s = long.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(key).alias("k")).agg(F.collect_list(F.struct(F.unix_date(at).alias("d"), F.col(value).cast("double").alias("v"))).alias("_s"))
    s = s.select("k", F.col("_s.d").alias("d"), F.col("_s.v").alias("v"))
    n = max(1, math.ceil(long.select(key).distinct().count() / members))
    s = s.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    s = s.withColumn("p", F.least("block", "_o")).withColumn("q", F.greatest("block", "_o")).drop("_o")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        days = np.unique(np.concatenate(g["d"].to_list()))

        def matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x, m = np.zeros((len(rows), len(days))), np.zeros((len(rows), len(days)))
            for i, (d, v) in enumerate(zip(rows["d"], rows["v"])):
                c = np.searchsorted(days, d)
                x[i, c], m[i, c] = np.asarray(v) - np.mean(v), 1.0  # near zero, so that sums of squares keep their digits
            return rows["k"].to_numpy(), x, m

        same = g["p"].iloc[0] == g["q"].iloc[0]
        ka, xa, ma = matrix(g[g["block"] == g["p"]])
        kb, xb, mb = (ka, xa, ma) if same else matrix(g[g["block"] == g["q"]])
        k = ma @ mb.T
        with np.errstate(divide="ignore", invalid="ignore"):
            sx, sy, xx, yy = xa @ mb.T, ma @ xb.T, (xa * xa) @ mb.T, ma @ (xb * xb).T
            vx, vy = xx - sx * sx / k, yy - sy * sy / k
            corr = (xa @ xb.T - sx * sy / k) / np.sqrt(vx * vy)
            # no correlation where a member does not vary over the shared days
            link = (k >= least) & (vx > 1e-12 * xx + 1e-24) & (vy > 1e-12 * yy + 1e-24) & (corr >= atleast)
        i, j = np.nonzero(np.triu(link, 1) if same else link)
        ends = [sorted(e) for e in zip(ka[i], kb[j])]
        return pd.DataFrame({"a": pd.Series([e[0] for e in ends], dtype=object), "b": pd.Series([e[1] for e in ends], dtype=object), "n": k[i, j].astype("int64"), "corr": corr[i, j]})

    kind = long.schema[key].dataType.simpleString()
    return s.groupBy("p", "q").applyInPandas(run, f"a {kind}, b {kind}, n bigint, corr double")


def neighbours(df: DataFrame, key: str | list[str], order: list[Column], n: int = 3) -> DataFrame:
    """The n first rows per key with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def calendar_pairs(ranked: DataFrame, key: str | list[str], item: str, value: str) -> DataFrame:
    """First item of a key against its second and third."""
    key = [key] if isinstance(key, str) else key
    near = ranked.where("rank = 1").select(*key, F.col(item).alias("near"), F.col(value).alias("near_value"))
    far = ranked.where("rank in (2, 3)").select(*key, F.col(item).alias("far"), F.col(value).alias("far_value"), "rank")
    return near.join(far, key).withColumn("spread", F.col("far_value") - F.col("near_value"))


def expression(long: DataFrame, symbols: list[str], formula: str, at: str = "day") -> DataFrame:
    """A formula over symbols (+ - * / and numbers) where all of them have a value; A, B, ... name them in order."""
    names = [chr(65 + i) for i in range(len(symbols))]
    if not set(formula) <= set("+-*/(). 0123456789" + "".join(names)):
        raise ValueError("only numbers, + - * / and the letters of the symbols are allowed")
    agg = [F.max(F.when(F.col("symbol") == s, F.col("close"))).alias(n) for s, n in zip(symbols, names)]
    wide = long.where(F.col("symbol").isin(symbols)).groupBy(at).agg(*agg)
    for n in names:
        wide = wide.where(F.col(n).isNotNull())
    return wide.select(at, F.expr(formula).alias("value"))


def merge_holdings(holdings: DataFrame, trades: DataFrame) -> DataFrame:
    """Settles positions into holdings: quantities add up, the price is the
    weighted average, what comes to zero is left out."""
    h = holdings.select("symbol", F.col("qty").alias("hq"), F.col("price").alias("hp"))
    t = trades.select("symbol", F.col("qty").alias("tq"), F.col("price").alias("tp"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    j = h.join(t, "symbol", "full_outer").withColumn("qty", z("hq") + z("tq"))
    return j.where("qty <> 0").select("symbol", "qty", ((z("hq") * z("hp") + z("tq") * z("tp")) / F.col("qty")).alias("price"))
