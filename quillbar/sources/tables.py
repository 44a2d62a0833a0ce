"""Table readers. Every reader selects columns lazily, so pruning and filters
reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IST_OFFSET = 19800  # seconds; market days are days in India

#: Seconds of a period of each intraday interval.
STEP_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeeze(c: Column | str) -> Column:
    """A text without surrounding blanks; null when nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", ""), F.lit(""))


def key_text(c: Column | str) -> Column:
    """A reference key: blanks and case do not matter, nothing left is null."""
    return F.upper(squeeze(c))


def ist_day(ts: Column | str) -> Column:
    """Day in India of an instant in epoch seconds."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_from_unix_date(F.floor((ts + F.lit(IST_OFFSET)) / F.lit(86400)).cast("int"))


def latest_bars(bars: DataFrame, *keep: str) -> DataFrame:
    """One row per (symbol, exchange, interval, timestamp): the row with the
    latest created_at; among equals the largest figures, so that the choice does
    not depend on the order of arrival. Rows with a null in the key are left out:
    they name no bar. ``max_by`` aggregates before the shuffle, so copies of a
    bar never travel."""
    keep = keep or ("open", "high", "low", "close", "volume", "oi")
    key = ["symbol", "exchange", "interval", "timestamp"]
    val = F.struct(*keep)
    order = F.struct(F.col("created_at").isNotNull(), F.col("created_at"), *keep)
    return (
        bars.where(" and ".join(f"`{k}` is not null" for k in key))
        .groupBy(*key)
        .agg(F.max_by(val, order).alias("v"))
        .select(*key, *[F.col(f"v.{k}").alias(k) for k in keep])
    )


def newest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keeps one row per key, the first by ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
