"""Rolling totals over trailing periods.

Every daily total is exploded onto each output day it influences, one
aggregation per (entity, output day) adds them up, and a join to the entity's
calendar rows brings the days without activity as zeros.

Scale: before the explosion, daily rows are laid out by (entity, block of 64
days), so the partial aggregation folds the up to 30 copies of a day into about
one row per output day before the shuffle; a hot entity is spread over its
blocks. No group is collected.

Defined results: days without a row count as no volume and no close (total 0,
average null); null volumes add nothing; closes that are null or not finite are
no close; several readings of one day are added up; an entity with one day has
one row; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = 64


def rolling_totals(daily: DataFrame, keys: list[str], day: str, total: str, mean: str, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Totals of ``total`` and averages of ``mean`` over the trailing ``periods``
    days (that day included) for every calendar day from the first to the last."""
    finite = F.when(~F.isnan(mean) & (F.abs(mean) < float("inf")), F.col(mean))
    d = daily.where(" and ".join(f"{c} is not null" for c in [*keys, day])).select(
        *keys, F.col(day).alias("day"), F.coalesce(F.col(total), F.lit(0)).alias("v"), finite.cast("double").alias("m")
    )
    d = d.groupBy(*keys, "day").agg(F.sum("v").alias("v"), F.sum("m").alias("s"), F.count("m").alias("c"))
    widest = max(periods)
    spread = d.withColumn("_block", F.floor(F.unix_date("day") / F.lit(_BLOCK))).repartition(*keys, "_block")
    hit = spread.select(*keys, "v", "s", "c", F.posexplode(F.sequence(F.col("day"), F.date_add("day", widest - 1))).alias("age", "day"))
    aggs = []
    for n in periods:
        within = F.col("age") < n
        aggs += [
            F.sum(F.when(within, F.col("v"))).alias(f"{total}_{n}d"),
            F.sum(F.when(within, F.col("s"))).alias(f"_s{n}"),
            F.sum(F.when(within, F.col("c"))).alias(f"_c{n}"),
        ]
    sums = hit.groupBy(*keys, "day").agg(*aggs)
    span = d.groupBy(*keys).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    calendar = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias("day"))
    out = calendar.join(sums, [*keys, "day"], "left")
    cols = [*keys, "day"]
    for n in periods:
        cols += [
            F.coalesce(F.col(f"{total}_{n}d"), F.lit(0)).cast("bigint").alias(f"{total}_{n}d"),
            F.round(F.when(F.col(f"_c{n}") > 0, F.col(f"_s{n}") / F.col(f"_c{n}")), 6).alias(f"{mean}_avg_{n}d"),
        ]
    return out.select(*cols)
