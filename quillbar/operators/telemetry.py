"""Roll-ups of logged measurements: latency, health, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latency_rollup(log: DataFrame, group: str, tag: str, ms: str, failed: Column) -> DataFrame:
    """Totals per tag, per group and for all in one pass: sums and counts add up
    across levels, and averages are taken from the sums of their own level."""
    r = log.rollup(group, tag).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(failed.cast("int")).cast("bigint").alias("failed"),
        F.sum(ms).alias("total_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
    )
    return r.select(
        F.coalesce(group, F.lit("all")).alias(group), F.coalesce(tag, F.lit("all")).alias(tag), F.col("level").cast("int").alias("level"), "n", "failed",
        (F.col("total_ms") / F.col("n")).alias("avg_ms"), "min_ms", "max_ms", (F.lit(1.0) - F.col("failed") / F.col("n")).alias("success_rate"),
    )


def percentiles(log: DataFrame, keys: list[str], ms: str, levels: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles by linear interpolation per key."""
    p = F.percentile(ms, F.array(*[F.lit(x) for x in levels]))
    return log.groupBy(*keys).agg(F.count("*").alias("n"), p.alias("_p")).select(*keys, "n", *[F.col("_p")[i].alias(f"p{int(x * 100)}") for i, x in enumerate(levels)])


def threshold_buckets(log: DataFrame, keys: list[str], ms: str, edges: tuple[float, float, float]) -> DataFrame:
    """Counts per quality class."""
    a, b, c = edges
    v = F.col(ms)
    k = lambda x: F.sum(x.cast("int")).cast("bigint")
    return log.groupBy(*keys).agg(
        k(v < a).alias("excellent"), k((v >= a) & (v < b)).alias("good"), k((v >= b) & (v < c)).alias("acceptable"), k(v >= c).alias("slow")
    )


def health_summary(metrics: DataFrame, keys: list[str], value: str, order: Column, status: Column) -> DataFrame:
    """Current, average, lowest and highest value, and counts by status."""
    count = lambda x: F.sum((status == x).cast("int")).cast("bigint")
    return metrics.groupBy(*keys).agg(
        F.max_by(value, order).alias("current"), F.avg(value).alias("average"), F.min(value).alias("lowest"), F.max(value).alias("highest"),
        count("pass").alias("passed"), count("warn").alias("warned"), count("fail").alias("failed"),
    )
