"""What changed between full snapshots.

Snapshots are kept range-partitioned and sorted by key. Each range streams its
snapshots one behind the other and merges neighbours with two pointers over the
two sorted key columns, comparing the watched columns and emitting typed
changes.

Scale: repeated rows of a key fold before the shuffle (max_by aggregates
partially); a range holds a bounded share of the keys, and a worker holds only
that share of two neighbouring snapshots. Only the list of snapshot dates (one
per delivery) is known to all ranges, so a range that is empty in a snapshot
still reports its removals.

Defined results: rows without exchange, token or snapshot date identify no
record and are left out; of one key in a snapshot the row with the highest
order value counts; null equals null; the first snapshot gives no rows; empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbar.sources.tables import squeeze

_NULL = "\x00"


def expiry_date(c: str) -> Column:
    """An expiry in any of the delivered forms as a date; blank is null."""
    t = F.initcap(squeeze(c))
    forms = ["dd-MMM-yy", "dd-MMM-yyyy", "ddMMMyy", "ddMMMyyyy", "dd MMM yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyyMMdd", "dd/MMM/yyyy"]
    long_year = t.rlike(r"\d{4}$|^\d{4}")
    tries = [F.when(long_year if "yyyy" in f else ~long_year, F.to_date(F.try_to_timestamp(t, F.lit(f)))) for f in forms]
    return F.coalesce(*tries)


def latest_futures(instruments: DataFrame) -> DataFrame:
    """Futures of the latest snapshot, one row per (exchange, name, symbol), with
    ``expiry_on`` from any delivered form; those without an underlying or an
    expiry are left out, an expiry of no known form is null."""
    live = instruments.where("instrumenttype = 'FUT' and trim(name) <> '' and trim(expiry) <> ''").where(F.col("snapshot_date") == instruments.agg(F.max("snapshot_date")).scalar())
    return live.groupBy("exchange", "name", "symbol").agg(F.min(expiry_date("expiry")).alias("expiry_on"))


def _state(kinds: dict[str, Column]) -> Column:
    """The watched columns as one comparable text, null included."""
    return F.concat_ws("\x01", *[F.coalesce(c.cast("string"), F.lit(_NULL)) for c in kinds.values()])


def _merge(pk: np.ndarray, ps: np.ndarray, ck: np.ndarray, cs: np.ndarray) -> list[tuple[str, str]]:
    """Two-pointer merge of two key-sorted snapshots of a range."""
    out, i, j, n, m = [], 0, 0, len(pk), len(ck)
    while i < n or j < m:
        if j >= m or (i < n and pk[i] < ck[j]):
            out.append((pk[i], "removed"))
            i += 1
        elif i >= n or ck[j] < pk[i]:
            out.append((ck[j], "added"))
            j += 1
        else:
            if ps[i] != cs[j]:
                out.append((ck[j], "changed"))
            i += 1
            j += 1
    return out


def snapshot_changes(rows: DataFrame, keys: dict[str, Column], snapshot: Column, order: Column, watched: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """(snapshot_date, *keys, change_kind) between consecutive snapshots.

    ``ranges``: number of key ranges, by default the session's number of shuffle
    partitions; raise it with the size of a snapshot."""
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.concat_ws("\x01", *keys.values())
    keep = rows.where(snapshot.isNotNull())
    for c in keys.values():
        keep = keep.where(c.isNotNull())
    state = keep.select(snapshot.cast("string").alias("snap"), key.alias("k"), order.alias("o"), _state(watched).alias("s"))
    state = state.groupBy("snap", "k").agg(F.max_by("s", F.struct("o", "s")).alias("s"))
    # one date per delivery: a few hundred for years of snapshots
    dates = sorted(r[0] for r in rows.select(snapshot.cast("string").alias("d")).where("d is not null").distinct().collect())
    after = dict(zip(dates, dates[1:]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = np.array([], dtype=object)
        prev: tuple[str | None, np.ndarray, np.ndarray] = (None, empty, empty)
        snap, ks, ss = None, [], []

        def close() -> list[tuple[str, str, str]]:
            """Ends the snapshot that was read: merges it with the one before, also over snapshots without a row here."""
            nonlocal prev
            ck = np.concatenate(ks) if ks else empty
            cs = np.concatenate(ss) if ss else empty
            out = []
            before, pk, ps = prev
            if before is not None and after[before] != snap:  # the range was empty in between
                out += [(after[before], k, w) for k, w in _merge(pk, ps, empty, empty)]
                pk, ps = empty, empty
            if snap != dates[0]:
                out += [(snap, k, w) for k, w in _merge(pk, ps, ck, cs)]
            prev = (snap, ck, cs)
            return out

        def frame(out: list[tuple[str, str, str]]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["snap", "k", "change_kind"])

        for b in batches:
            for d, g in b.groupby("snap", sort=False):
                if d != snap:
                    if snap is not None and (out := close()):
                        yield frame(out)
                    snap, ks, ss = d, [], []
                ks.append(g["k"].to_numpy(object))
                ss.append(g["s"].to_numpy(object))
        if snap is not None:
            out = close()
            if snap in after:
                out += [(after[snap], k, "removed") for k in prev[1]]
            if out:
                yield frame(out)

    merged = state.repartitionByRange(ranges, "k").sortWithinPartitions("snap", "k").mapInPandas(run, "snap string, k string, change_kind string")
    parts = F.split("k", "\x01")
    return merged.select(F.col("snap").alias("snapshot_date"), *[parts[i].alias(n) for i, n in enumerate(keys)], "change_kind")


def instrument_changes(symtoken: DataFrame, ranges: int | None = None) -> DataFrame:
    """Changes of lot size, expiry (as a date) and tick size (to six decimals) per exchange and token."""
    return snapshot_changes(
        symtoken,
        {"exchange": squeeze("exchange"), "token": squeeze("token")},
        F.col("snapshot_date"),
        F.col("id"),
        {
            "lotsize": F.col("lotsize"),
            "expiry": expiry_date("expiry"),
            "tick_size": F.when(~F.isnan("tick_size"), F.round("tick_size", 6)),
        },
        ranges,
    )
