"""Option-chain analytics. A chain is long: expiry, strike, side (CE, PE), oi, volume, ltp."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbar.functions.mathx import norm_cdf, norm_pdf, safe_div


def wide(chain: DataFrame) -> DataFrame:
    """One row per (expiry, strike) with both sides."""
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s.lower()}_{c}")
    return chain.groupBy("expiry", "strike").agg(*[side(s, c) for s in ("CE", "PE") for c in ("oi", "volume", "ltp")])


def totals(chain: DataFrame) -> DataFrame:
    """Open interest and volume per side with put-call ratios (0 without calls)."""
    t = lambda s, c: F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0.0))
    g = chain.groupBy("expiry").agg(*[t(s, c).alias(f"{s.lower()}_{c}") for s in ("CE", "PE") for c in ("oi", "volume")])
    return g.withColumn("pcr_oi", F.round(safe_div(F.col("pe_oi"), F.col("ce_oi"), 0.0), 2)).withColumn("pcr_volume", F.round(safe_div(F.col("pe_volume"), F.col("ce_volume"), 0.0), 2))


def pain(chain: DataFrame) -> DataFrame:
    """What writers would pay at each candidate strike. Sums over lower and higher
    strikes are running totals, so no strike meets every other."""
    w = wide(chain).select("expiry", "strike", F.coalesce("ce_oi", F.lit(0.0)).alias("c"), F.coalesce("pe_oi", F.lit(0.0)).alias("p"))
    below = Window.partitionBy("expiry").orderBy("strike").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("expiry").orderBy("strike").rowsBetween(1, Window.unboundedFollowing)
    s = lambda x, o: F.coalesce(F.sum(x).over(o), F.lit(0.0))
    k = F.col("strike")
    return w.select("expiry", "strike", (k * s("c", below) - s(F.col("strike") * F.col("c"), below) + s(F.col("strike") * F.col("p"), above) - k * s("p", above)).alias("pain"))


def max_pain(chain: DataFrame) -> DataFrame:
    """Strike of the least pain per expiry, the lowest on ties."""
    return pain(chain).groupBy("expiry").agg(F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"), F.min("pain").alias("pain"))


def exposure(chain: DataFrame, spot: float, lot: float = 1.0) -> DataFrame:
    """Gamma and delta exposure per strike: gamma * oi * lot * spot^2 / 100 and
    delta * oi * lot * spot, both in units of 1e7; puts count negative for gamma.
    A side with open interest but without greeks is marked as unpriced."""
    sign = F.when(F.col("side") == "CE", 1.0).otherwise(-1.0)
    c = chain.withColumn("gex", sign * F.coalesce("gamma", F.lit(0.0)) * F.col("oi") * lot * spot * spot * 0.01 / 1e7)
    c = c.withColumn("dex", F.coalesce("delta", F.lit(0.0)) * F.col("oi") * lot * spot / 1e7)
    return c.groupBy("expiry", "strike").agg(
        F.sum(F.when(F.col("side") == "CE", F.col("gex"))).alias("ce_gex"), F.sum(F.when(F.col("side") == "PE", F.col("gex"))).alias("pe_gex"),
        F.sum("gex").alias("gex"), F.sum("dex").alias("dex"), F.max((F.col("gamma").isNull() & (F.col("oi") > 0))).alias("unpriced"),
    )


def walls(profile: DataFrame) -> DataFrame:
    """Strikes of the largest call and put exposure, the lowest on ties, and the net per expiry."""
    return profile.groupBy("expiry").agg(
        F.max_by("strike", F.struct(F.coalesce("ce_gex", F.lit(0.0)), -F.col("strike"))).alias("call_wall"),
        F.min_by("strike", F.struct(F.coalesce("pe_gex", F.lit(0.0)), F.col("strike"))).alias("put_wall"), F.sum("gex").alias("net_gex"),
    )


def peaks(profile: DataFrame, share: float = 0.2) -> DataFrame:
    """Cells of at least a share of their expiry's largest absolute exposure."""
    top = F.max(F.abs("gex")).over(Window.partitionBy("expiry"))
    return profile.withColumn("_t", top).where(F.abs("gex") >= share * F.col("_t")).drop("_t")


# ---- pricing on the forward
def d1_d2(f: Column, k: Column, t: Column, s: Column) -> tuple[Column, Column]:
    d1 = (F.log(f / k) + s * s * t / 2) / (s * F.sqrt(t))
    return d1, d1 - s * F.sqrt(t)


def black76(f: Column, k: Column, t: Column, s: Column, call: Column, r: float = 0.0) -> Column:
    d1, d2 = d1_d2(f, k, t, s)
    df = F.exp(-F.lit(r) * t)
    return df * F.when(call, f * norm_cdf(d1) - k * norm_cdf(d2)).otherwise(k * norm_cdf(-d2) - f * norm_cdf(-d1))


def greeks(df: DataFrame, f: str, k: str, t: str, s: str, call: Column, r: float = 0.0) -> DataFrame:
    """delta, gamma, theta per day, vega per 1 % and rho per 1 %. A leg without
    time or volatility has a delta of 1, -1 or 0 and no other greek."""
    F_, K, T, S = (F.col(c) for c in (f, k, t, s))
    d1, d2 = d1_d2(F_, K, T, S)
    disc = F.exp(-F.lit(r) * T)
    ok = (T > 0) & (S > 0) & (F_ > 0) & (K > 0)
    flat = F.when(call, F.when(F_ > K, 1.0).otherwise(0.0)).otherwise(F.when(F_ < K, -1.0).otherwise(0.0))
    price = black76(F_, K, T, S, call, r)
    g = lambda e, z=0.0: F.when(ok, e).otherwise(z)
    return df.select(
        "*", g(disc * F.when(call, norm_cdf(d1)).otherwise(norm_cdf(d1) - 1), flat).alias("delta"), g(disc * norm_pdf(d1) / (F_ * S * F.sqrt(T))).alias("gamma"),
        g((-F_ * disc * norm_pdf(d1) * S / (2 * F.sqrt(T)) + F.lit(r) * price) / 365).alias("theta"), g(F_ * disc * norm_pdf(d1) * F.sqrt(T) / 100).alias("vega"), g(-T * price / 100).alias("rho"),
    )


_erf = np.frompyfunc(math.erf, 1, 1)


def _price(f, k, t, s, call):
    sd = s * np.sqrt(t)
    d1 = (np.log(f / k) + sd * sd / 2) / sd
    n = lambda x: 0.5 * (1 + _erf(x / math.sqrt(2)).astype(float))
    c = f * n(d1) - k * n(d1 - sd)
    return np.where(call, c, c - f + k)


def implied_volatility(df: DataFrame, f: str, k: str, t: str, price: str, call: str, highest: float = 5.0) -> DataFrame:
    """Adds iv by bisection over whole Arrow batches; null where the price is not
    above its intrinsic value, not below the bound of the highest volatility, or
    an input is missing or not positive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            F_, K, T, X = (b[c].to_numpy(dtype=float, na_value=np.nan) for c in (f, k, t, price))
            C = b[call].fillna(False).to_numpy(bool)
            ok = (F_ > 0) & (K > 0) & (T > 0) & (X > 0) & ~b[call].isna().to_numpy()
            ok &= X > np.where(C, F_ - K, K - F_)
            iv = np.full(len(b), np.nan)
            if ok.any():
                a = [v[ok] for v in (F_, K, T)]
                x, c = X[ok], C[ok]
                lo, hi = np.full(len(x), 1e-6), np.full(len(x), highest)
                reach = _price(*a, hi, c) >= x
                for _ in range(60):
                    mid = (lo + hi) / 2
                    low = _price(*a, mid, c) < x
                    lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
                iv[ok] = np.where(reach, (lo + hi) / 2, np.nan)
            yield b.assign(iv=pd.Series(iv, index=b.index).astype(object).where(~np.isnan(iv), None))

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, iv double")


def quote_price(bid: Column, ask: Column, ltp: Column) -> Column:
    """Middle of bid and ask, unless they are missing or crossed."""
    return F.when((bid > 0) & (ask >= bid), (bid + ask) / 2).otherwise(ltp)


def forward_from_parity(chain: DataFrame) -> DataFrame:
    """Strike + call - put at the strike where both sides are nearest to each other."""
    w = wide(chain).where("ce_ltp is not null and pe_ltp is not null")
    w = w.withColumn("gap", F.abs(F.col("ce_ltp") - F.col("pe_ltp"))).withColumn("fwd", F.col("strike") + F.col("ce_ltp") - F.col("pe_ltp"))
    return w.groupBy("expiry").agg(F.min_by("strike", F.struct("gap", "strike")).alias("atm"), F.min_by("fwd", F.struct("gap", "strike")).alias("forward"))


def atm_strike(price: Column, interval: Column) -> Column:
    """Price rounded to the strike interval, halves upwards."""
    return F.floor(price / interval + 0.5) * interval


def year_fraction(expiry_ts: Column, as_of: Column) -> Column:
    """Years to expiry, at least 0.0001."""
    return F.greatest(F.lit(0.0001), (expiry_ts - as_of) / (365.0 * 86400))


def smile(chain: DataFrame, forward: float, otm: float = 0.05) -> DataFrame:
    """Mean volatility at the strike nearest to the forward, and the skew: put
    volatility below minus call volatility above, each nearest to its distance."""
    def nearest(target: float, side: str) -> Column:
        x = F.when((F.col("side") == side) & F.col("iv").isNotNull(), F.struct(F.abs(F.col("strike") - target).alias("d"), "strike"))
        return F.min_by("iv", x)

    return chain.groupBy("expiry").agg(
        ((nearest(forward, "CE") + nearest(forward, "PE")) / 2).alias("atm_iv"), (nearest(forward * (1 - otm), "PE") - nearest(forward * (1 + otm), "CE")).alias("skew")
    )


def surface(chain: DataFrame, forward: float) -> DataFrame:
    """Out-of-the-money volatility on the strikes that every expiry has; empty cells stay null."""
    n = chain.agg(F.count_distinct("expiry")).scalar()
    common = chain.groupBy("strike").agg(F.count_distinct("expiry").alias("_n")).where(F.col("_n") == n).select("strike")
    otm = F.when(F.col("strike") >= forward, F.col("side") == "CE").otherwise(F.col("side") == "PE")
    return chain.join(common, "strike", "left_semi").groupBy("expiry", "strike").agg(F.max(F.when(otm, F.col("iv"))).alias("iv"))


def gamma_density(chain: DataFrame, spot: float, t: float) -> DataFrame:
    """Gamma times open interest per strike at one horizon; a missing volatility
    is replaced by the upper median of the expiry's."""
    vols = F.array_sort(F.collect_list("iv").over(Window.partitionBy("expiry")))
    c = chain.withColumn("_v", vols).withColumn("_iv", F.coalesce("iv", F.try_element_at("_v", (F.floor(F.size("_v") / 2) + 1).cast("int"))))
    d1, _ = d1_d2(F.lit(spot), F.col("strike"), F.lit(t), F.col("_iv"))
    g = norm_pdf(d1) / (F.lit(spot) * F.col("_iv") * math.sqrt(t))
    return c.groupBy("expiry", "strike").agg(F.sum(g * F.col("oi")).alias("density"))


def gamma_flip(chain: DataFrame, spot: float, t: float, width: float = 0.1, points: int = 241) -> DataFrame:
    """Price nearest to the spot at which the net gamma exposure changes its sign,
    by linear interpolation on a grid of prices."""
    lo, step = spot * (1 - width), 2 * width * spot / (points - 1)
    g = chain.where("iv > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.lit(lo) + F.col("i") * step)
    d1, _ = d1_d2(F.col("x"), F.col("strike"), F.lit(t), F.col("iv"))
    e = F.when(F.col("side") == "CE", 1.0).otherwise(-1.0) * norm_pdf(d1) / (F.col("x") * F.col("iv") * math.sqrt(t)) * F.col("oi")
    net = g.groupBy("expiry", "i", "x").agg(F.sum(e).alias("y"))
    w = Window.partitionBy("expiry").orderBy("i")
    n = net.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("y * y2 < 0 or y = 0")
    root = F.when(F.col("y") == 0, F.col("x")).otherwise(F.col("x") + (F.col("x2") - F.col("x")) * F.col("y") / (F.col("y") - F.col("y2")))
    return n.withColumn("flip", root).groupBy("expiry").agg(F.min_by("flip", F.struct(F.abs(F.col("flip") - spot), "flip")).alias("flip"))


def oi_change(daily_oi: DataFrame, keys: list[str], day: str, oi: str) -> DataFrame:
    """Open interest of the last day against the day before; without one the change is 0."""
    w = Window.partitionBy(*keys).orderBy(F.desc(day))
    r = daily_oi.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    return r.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col(oi))).alias("oi"), F.coalesce(F.max(F.when(F.col("_r") == 1, F.col(oi))) - F.max(F.when(F.col("_r") == 2, F.col(oi))), F.lit(0)).alias("change")
    )


def option_symbol(name: Column, expiry: Column, strike: Column, side: Column) -> Column:
    """NAME + DDMMMYY + strike (without .0) + side."""
    k = F.when(strike == F.floor(strike), strike.cast("bigint").cast("string")).otherwise(F.format_string("%s", strike))
    return F.concat(name, F.upper(F.date_format(expiry, "ddMMMyy")), k, side)


SYMBOL_FORM = r"^([A-Z&-]+?)(\d{2}[A-Z]{3}\d{2})(\d+(?:\.\d+)?)?(CE|PE|FUT)$"


def parse_symbol(symbol: Column) -> dict[str, Column]:
    """Parts of a derivative symbol; empty texts where it is none."""
    g = lambda i: F.regexp_extract(symbol, SYMBOL_FORM, i)
    return {"base": g(1), "expiry": g(2), "strike": g(3), "kind": g(4)}
