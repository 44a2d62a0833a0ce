"""Scalar functions that have no built-in: the normal distribution, safe division, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column, terms: int = 120) -> Column:
    """By the series 1/2 + pdf(x) * (x + x^3/3 + x^5/(3*5) + ...), exact to double
    precision for |x| < 8, beyond which it is 0 or 1."""
    y = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), x))
    run = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(y.alias("t"), y.alias("s")),
        lambda a, k: F.struct((a.t * y * y / (2 * k + 1)).alias("t"), (a.s + a.t * y * y / (2 * k + 1)).alias("s")),
        lambda a: a.s,
    )
    return F.when(x >= 8, 1.0).when(x <= -8, 0.0).otherwise(F.lit(0.5) + norm_pdf(y) * run)


def safe_div(a: Column, b: Column, default: float | None = None) -> Column:
    q = F.when(b != 0, a / b)
    return q if default is None else F.coalesce(q, F.lit(default))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def seed_of(text: Column) -> Column:
    """A 32-bit seed from a text."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
