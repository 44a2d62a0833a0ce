"""Readers of files and feeds: CSV dumps and lists, signal files, paged history
as a Python data source, generators, option-chain snapshots."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillbar.sources.tables import ist_day

HISTORY = "timestamp bigint, open double, high double, low double, close double, volume bigint, oi bigint"
#: Rows one history answer may have.
HISTORY_LIMIT = 200_000


def instrument_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV dump with a header; the schema is given, never inferred."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """First column of a CSV without a header."""
    return spark.read.csv(path, header=False).select(F.upper(F.trim("_c0")).alias("symbol")).where("symbol <> ''")


#: Columns of a bar file and their types.
BAR_FILE = "timestamp bigint, open double, high double, low double, close double, volume bigint, oi bigint"


def import_bars(spark: SparkSession, path: str, fmt: str, symbol: str, exchange: str, interval: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) bars of an uploaded CSV (with a header) or Parquet file,
    stamped with the series they are for. A row is rejected with a reason: a value
    that is no number (``value``), prices that contradict each other (``prices``)."""
    if fmt not in ("csv", "parquet"):
        raise ValueError("format must be csv or parquet")
    kinds = {c.split()[0]: c.split()[1] for c in BAR_FILE.split(", ")}
    raw = spark.read.csv(path, header=True) if fmt == "csv" else spark.read.parquet(path)
    names = {c.strip().lower(): c for c in raw.columns}
    lost = [c for c in kinds if c not in names and c != "oi"]
    if lost:
        raise ValueError(f"bar file lacks {lost}")
    cast = [F.expr(f"try_cast(trim(`{names[c]}`) as {t})" if fmt == "csv" else f"try_cast(`{names[c]}` as {t})").alias(c) if c in names else F.lit(0).cast(t).alias(c) for c, t in kinds.items()]
    b = raw.select(F.lit(symbol.upper()).alias("symbol"), F.lit(exchange).alias("exchange"), F.lit(interval).alias("interval"), *cast)
    given = " and ".join(f"{c} is not null" for c in kinds if c not in ("volume", "oi"))
    sane = "open > 0 and high > 0 and low > 0 and low <= least(open, close) and high >= greatest(open, close) and high < 1e300 and coalesce(volume, 0) >= 0"
    why = F.when(~F.expr(given), "value").when(~F.expr(sane), "prices")
    b = b.withColumn("reason", why).withColumn("volume", F.coalesce("volume", F.lit(0))).withColumn("oi", F.coalesce("oi", F.lit(0)))
    return b.where("reason is null").drop("reason"), b.where("reason is not null")


def sine_page(lo: int, hi: int) -> list[tuple]:
    """A deterministic page of minute bars, for trying a paged feed."""
    return [(t, 100.0 + t % 7, 110.0 + t % 7, 90.0, 101.0 + t % 5, t % 1000) for t in range(-(-lo // 60) * 60, hi, 60)]


#: Names under which signal files carry a field, letters and digits only. Fixed values.
ALIASES = {
    "day": ("date", "signaldate", "scandate"), "timestamp": ("timestamp", "datetime"), "time": ("signaltime", "time"), "symbol": ("symbol", "ticker", "nsesymbol"),
    "sector": ("sector", "industry"), "marketcap": ("marketcapname", "marketcap"), "exchange": ("exchange", "tradingexchange"), "asset_class": ("assetclass", "assettype", "instrumenttype"),
}


def resolve_header(columns: list[str]) -> dict[str, str]:
    """Field -> column; a field that two columns could be is an error, and so is a
    file without a symbol, or with neither a date nor a timestamp."""
    plain = {c: "".join(x for x in c.lstrip("\ufeff").lower() if x.isalnum()) for c in columns}
    out: dict[str, str] = {}
    for field, names in ALIASES.items():
        hit = [c for c, p in plain.items() if p in names]
        if len(hit) > 1:
            raise ValueError(f"columns {hit} are all {field}")
        if hit:
            out[field] = hit[0]
    if "symbol" not in out or not {"day", "timestamp"} & set(out):
        raise ValueError("a signal file needs a symbol column and a date or timestamp column")
    return out


def signals(raw: DataFrame, row: str = "row") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) signals of a file that was read as text columns with a
    row number: two date forms, or the day in India of an ISO timestamp (without a
    zone it is India); symbols of letters, digits, & and -; the first of equal
    signals is kept; rejects carry a reason."""
    h = resolve_header([c for c in raw.columns if c != row])
    col = lambda f: F.trim(F.col(f"`{h[f]}`")) if f in h else F.lit(None).cast("string")
    stamp = F.when(col("timestamp").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(col("timestamp"))).otherwise(F.try_to_timestamp(F.concat(col("timestamp"), F.lit("+05:30"))))
    day = F.coalesce(*[F.to_date(F.try_to_timestamp(col("day"), F.lit(p))) for p in ("yyyy-MM-dd", "dd-MM-yyyy")], F.when(col("day").isNull(), ist_day(F.unix_seconds(stamp))))
    s = raw.select(
        F.col(row).alias("row"), day.alias("signal_date"), F.upper(col("symbol")).alias("symbol"), col("timestamp").alias("timestamp"), col("time").alias("time"),
        col("sector").alias("sector"), col("marketcap").alias("marketcapname"), col("exchange").alias("exchange"), col("asset_class").alias("asset_class"),
    )
    why = F.when(F.col("signal_date").isNull(), "date").when(~F.coalesce(F.col("symbol").rlike(r"^[A-Z0-9&-]{1,32}$"), F.lit(False)), "symbol")
    s = s.withColumn("reason", why)
    good = s.where("reason is null").drop("reason")
    rest = [c for c in good.columns if c not in ("signal_date", "symbol")]
    first = good.groupBy("signal_date", "symbol").agg(F.min_by(F.struct(*rest), "row").alias("v")).select("signal_date", "symbol", *[F.col(f"v.{c}").alias(c) for c in rest])
    return first, s.where("reason is not null").select("row", "reason")


def sine_bars(spark: SparkSession, symbols: list[str], start: str, days: int) -> DataFrame:
    """Deterministic weekday bars per symbol: a sine around a level, both from the
    hash of the symbol."""
    s = spark.createDataFrame([(x,) for x in symbols], "symbol string")
    seed = F.conv(F.substring(F.sha2("symbol", 256), 1, 8), 16, 10).cast("bigint")
    d = s.withColumn("seed", seed).select("symbol", "seed", F.posexplode(F.sequence(F.to_date(F.lit(start)), F.date_add(F.to_date(F.lit(start)), days - 1))).alias("i", "day"))
    level = F.lit(100.0) + F.col("seed") % 900
    close = F.round(level * (1 + F.sin((F.col("i") + F.col("seed") % 97) / 9.0) * 0.08), 2)
    b = d.where(F.weekday("day") < 5).withColumn("close", close)
    return b.select("symbol", "day", (F.col("close") * 0.998).alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close", (F.col("seed") % 5000 + F.col("i")).alias("volume"))


def weekdays(spark: SparkSession, start: str, end: str, holidays: list[str] = (), special: list[str] = ()) -> DataFrame:
    """Sessions of a calendar: weekdays that are no holidays, and special sessions whatever their day."""
    d = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("session_date"))
    day = F.col("session_date").cast("string")
    return d.where(day.isin(list(special)) | ((F.weekday("session_date") < 5) & ~day.isin(list(holidays))))


def chain_rows(snapshot: DataFrame) -> DataFrame:
    """Nested chain (expiry, chain: array of strike, ce, pe) to long rows."""
    flat = snapshot.select("expiry", F.inline("chain"))
    side = lambda s: flat.select("expiry", "strike", F.lit(s.upper()).alias("side"), F.col(f"{s}.oi").alias("oi"), F.col(f"{s}.volume").alias("volume"), F.col(f"{s}.ltp").alias("ltp")).where(F.col(s).isNotNull())
    return side("ce").unionByName(side("pe"))


class _Page(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.lo, self.hi, self.page = int(options["from"]), int(options["to"]), int(options.get("page", 86400))
        self.fetch = options["fetch"]

    def partitions(self) -> list[_Page]:
        """One partition per page, so pages are fetched side by side."""
        return [_Page(a, min(a + self.page, self.hi)) for a in range(self.lo, self.hi, self.page)]

    def read(self, p: _Page) -> Iterator[tuple]:
        import importlib

        mod, _, name = self.fetch.rpartition(":")
        n = 0
        for r in getattr(importlib.import_module(mod), name)(p.lo, p.hi):
            n += 1
            if n > HISTORY_LIMIT:
                raise ValueError(f"a page has more than {HISTORY_LIMIT} rows")
            row = list(r)
            if len(row) == 6:
                row.append(0)  # no open interest is 0
            if p.lo <= row[0] < p.hi:
                yield tuple(row)


class PagedHistory(DataSource):
    """``spark.read.format("paged_history")`` with from, to, page (seconds) and
    fetch (module:function of two bounds that gives rows)."""

    @classmethod
    def name(cls) -> str:
        return "paged_history"

    def schema(self) -> str:
        return HISTORY

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


def history(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """Bars from the archive (``db``: path) or from a paged feed (``api``)."""
    if source == "db":
        return spark.read.parquet(options["path"])
    if source == "api":
        spark.dataSource.register(PagedHistory)
        return spark.read.format("paged_history").options(**options).load().dropDuplicates(["timestamp"])
    raise ValueError("source must be db or api")


def check_history(df: DataFrame) -> DataFrame:
    """Required columns by name, open interest 0 where it is missing."""
    need = ["timestamp", "open", "high", "low", "close", "volume"]
    lost = [c for c in need if c not in df.columns]
    if lost or len(set(df.columns)) != len(df.columns):
        raise ValueError(f"history lacks {lost} or repeats a column")
    oi: Column = F.coalesce("oi", F.lit(0)) if "oi" in df.columns else F.lit(0)
    return df.select(*need, oi.cast("bigint").alias("oi"))


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 8) -> DataFrame:
    """A database table, read in parallel ranges of a numeric column if one is named."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return r.load()
