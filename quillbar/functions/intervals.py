"""Interval grammar and period arithmetic.

An interval is a count and a unit; units are case-sensitive: m minutes, h hours,
D days, W weeks, M months, Q quarters, Y years. Minutes and hours are built
from stored 1m bars, the rest from stored D bars."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillbar.sources.tables import IST_OFFSET, ist_day

_FORM = re.compile(r"(\d*)([mhDWMQY])", re.A)
LARGEST = 100_000
#: Session open of the day, in seconds after midnight in India (09:15).
OPEN_SECONDS = 33_300


@dataclass(frozen=True)
class Interval:
    count: int
    unit: str

    @property
    def source(self) -> str:
        return "1m" if self.unit in "mh" else "D"

    @property
    def seconds(self) -> int | None:
        return {"m": 60, "h": 3600}[self.unit] * self.count if self.unit in "mh" else None

    @property
    def months(self) -> int | None:
        return {"M": 1, "Q": 3, "Y": 12}[self.unit] * self.count if self.unit in "MQY" else None

    @property
    def native(self) -> bool:
        return self.count == 1 and self.unit in "mD"


def parse_interval(text: str) -> Interval | None:
    """The interval, or None where the text is none or its count is out of range."""
    m = _FORM.fullmatch(text or "")
    if not m:
        return None
    n = int(m[1] or 1)
    return Interval(n, m[2]) if 1 <= n <= LARGEST else None


def bucket_start(ts: Column, interval: Interval, open_seconds: int = OPEN_SECONDS) -> Column:
    """Start of the bucket of an epoch second.

    Intraday buckets count from the session open and start again every market
    day (readings before the open count backwards from it); days count from
    1970-01-01, weeks from Monday 1970-01-05, months from January of year 0.
    Day and longer buckets are labelled by their first calendar day at 00:00 UTC."""
    if interval.seconds:
        n = interval.seconds
        midnight = F.floor((ts + IST_OFFSET) / 86400) * 86400 - IST_OFFSET
        start = midnight + open_seconds
        return (start + F.floor((ts - start) / n) * n).cast("bigint")
    day = F.unix_date(ist_day(ts))
    if interval.unit == "D":
        return (F.floor(day / interval.count) * interval.count * 86400).cast("bigint")
    if interval.unit == "W":
        n = 7 * interval.count
        return ((F.floor((day - 4) / n) * n + 4) * 86400).cast("bigint")
    return (F.unix_date(month_bucket(ist_day(ts), interval.months)) * 86400).cast("bigint")


def month_bucket(day: Column, months: int) -> Column:
    """First day of the run of ``months`` months, counted from year 0, that holds the day."""
    index = F.floor((F.year(day) * 12 + F.month(day) - 1) / months) * months
    return F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1))
