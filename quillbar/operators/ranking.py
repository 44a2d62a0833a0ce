"""Exact positions within unboundedly large groups, without one task per group.

A group is cut by a bucket of its sort key; rows are numbered within a bucket,
and a prefix sum over the bucket counts gives each bucket its offset. Only the
bucket counts (not the rows) of a group meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """Adds the 0-based position of each row in its group. ``bucket`` must not
    decrease along ``order`` and should hold a bounded number of rows."""
    b = df.withColumn("_b", bucket)
    counts = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return local.join(offsets, [*keys, "_b"]).withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("bigint")).drop("_b", "_off", "_rn")


def blocks(df: DataFrame, rank: str, size: int, margin: int) -> DataFrame:
    """Cuts ranked groups into blocks of ``size`` rows and lends each block
    ``margin`` rows of its neighbours: adds ``block`` and ``core`` (the row
    belongs to the block and is not lent)."""
    home = F.floor(F.col(rank) / size)
    at = F.col(rank) % size
    near = F.array_compact(
        F.array(home, F.when((at < margin) & (home > 0), home - 1), F.when(at >= size - margin, home + 1))
    )
    return df.withColumn("_home", home).withColumn("block", F.explode(near)).withColumn("core", F.col("block") == F.col("_home")).drop("_home")


def running_before(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: str, name: str) -> DataFrame:
    """Adds the exact sum of ``value`` over the rows of the group before each row,
    with the same two levels as ``ranked``."""
    b = df.withColumn("_b", bucket)
    sums = b.groupBy(*keys, "_b").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = b.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(offsets, [*keys, "_b"]).withColumn(name, F.col("_off") + F.col("_in")).drop("_b", "_off", "_in")
