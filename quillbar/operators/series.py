"""Analytic window operators over keyed daily series (key, day, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by(key: str = "symbol", order: str = "day") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-n + 1, 0)


def full(expr: Column, n: int, value: str, w: WindowSpec) -> Column:
    """A frame aggregate that is null until its frame holds n values."""
    return F.when(F.count(value).over(w) == n, expr.over(w))


def returns(df: DataFrame, w: WindowSpec | None = None, value: str = "close") -> DataFrame:
    """Simple returns; the first row of a key has none and is left out."""
    w = w or by()
    return df.withColumn("ret", F.col(value) / F.lag(value).over(w) - 1).where("ret is not null")


def growth(df: DataFrame, w: WindowSpec | None = None, value: str = "close") -> DataFrame:
    """Growth ratio to the day before; the first is 1."""
    return df.withColumn("ratio", F.coalesce(F.col(value) / F.lag(value).over(w or by()), F.lit(1.0)))


def large_moves(df: DataFrame, limit: float = 0.35) -> DataFrame:
    """Moves beyond the limit, which look like unadjusted splits: count and dates per key."""
    r = returns(df).where(F.abs("ret") > limit)
    return r.groupBy("symbol").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.col("day").cast("string"))), ",").alias("days"))


def drawdowns(df: DataFrame, value: str = "close") -> DataFrame:
    """Running peak and relative drawdown."""
    return df.withColumn("peak", F.max(value).over(upto(by()))).withColumn("drawdown", F.col(value) / F.col("peak") - 1)


def max_drawdown(df: DataFrame, value: str = "close") -> DataFrame:
    """Deepest drawdown per key with its trough (the earliest on ties), and the
    first later day on which the peak before it was reached again."""
    d = drawdowns(df, value)
    t = d.groupBy("symbol").agg(F.min_by(F.struct("drawdown", "day", "peak"), F.struct("drawdown", "day")).alias("t"))
    t = t.select("symbol", F.col("t.drawdown").alias("max_drawdown"), F.col("t.day").alias("trough"), F.col("t.peak").alias("peak"))
    back = df.select("symbol", F.col("day").alias("d2"), F.col(value).alias("v2")).join(t, "symbol").where((F.col("d2") > F.col("trough")) & (F.col("v2") >= F.col("peak")))
    return t.join(back.groupBy("symbol").agg(F.min("d2").alias("recovered")), "symbol", "left")


def longest_runs(df: DataFrame, flag: Column) -> DataFrame:
    """Longest run of consecutive flagged rows per key, the earliest on ties."""
    w = by()
    d = df.withColumn("_f", flag.cast("int")).withColumn("_i", F.row_number().over(w) - F.sum("_f").over(upto(w)))
    runs = d.where("_f = 1").groupBy("symbol", "_i").agg(F.count("*").alias("length"), F.min("day").alias("start"), F.max("day").alias("end"))
    return runs.groupBy("symbol").agg(F.max_by(F.struct("length", "start", "end"), F.struct(F.col("length"), -F.unix_date("start"))).alias("r")).select("symbol", "r.*")


def current_run(df: DataFrame, label: Column) -> DataFrame:
    """Label of the last row per key and how many rows it has lasted."""
    w = by()
    d = df.withColumn("label", label)
    d = d.withColumn("_c", F.sum(F.when(F.lag("label").over(w).eqNullSafe(F.col("label")), 0).otherwise(1)).over(upto(w)))
    runs = d.groupBy("symbol", "_c").agg(F.max("label").alias("label"), F.count("*").alias("bars"))
    return runs.groupBy("symbol").agg(F.max_by(F.struct("label", "bars"), "_c").alias("r")).select("symbol", "r.*")


def efficiency(df: DataFrame, n: int = 20) -> DataFrame:
    """Net move over n rows against the path walked; 0 for a path of nothing, null before n moves."""
    w = by()
    d = df.withColumn("_d", F.abs(F.col("close") - F.lag("close").over(w)))
    path = full(F.sum("_d"), n, "_d", trailing(w, n))
    return d.withColumn("efficiency", F.when(path == 0, 0.0).otherwise(F.abs(F.col("close") - F.lag("close", n).over(w)) / path)).drop("_d")


def midrank(df: DataFrame, n: int = 90, relative: float = 1e-9, absolute: float = 1e-12) -> DataFrame:
    """Mid-rank percentile of a value among the n rows before it; null with fewer.
    Values within the relative and absolute tolerance of it are ties."""
    before = by().rowsBetween(-n, -1)
    d = df.withColumn("_w", F.collect_list("close").over(before))
    near = absolute + relative * F.abs(F.col("close"))
    less = F.size(F.filter("_w", lambda x: x < F.col("close") - near))
    equal = F.size(F.filter("_w", lambda x: F.abs(x - F.col("close")) <= near))
    return d.withColumn("midrank", F.when(F.size("_w") == n, (less + equal * 0.5) * 100.0 / n)).drop("_w")


def forward_fill(df: DataFrame, value: str, w: WindowSpec | None = None) -> DataFrame:
    return df.withColumn("filled", F.last(value, ignorenulls=True).over(upto(w or by())))


def weighted_mean(value: str, n: int, w: WindowSpec) -> Column:
    """Linear weights, the newest row the heaviest; null before n rows."""
    terms = [F.lag(value, k).over(w) * (n - k) for k in range(n)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / (n * (n + 1) / 2)


def walk_forward(df: DataFrame, window: int, step: int, key: str = "symbol") -> DataFrame:
    """Overlapping windows of ``window`` rows every ``step`` rows: start, end and
    total return of each full window. A row is exploded only onto the windows it
    is in."""
    w = Window.partitionBy(key)
    d = df.withColumn("_r", F.row_number().over(w.orderBy("day")) - 1).withColumn("_n", F.count("*").over(w))
    first = F.greatest(F.lit(0), F.ceil((F.col("_r") - window + 1) / step))
    last = F.least(F.floor(F.col("_r") / step), F.floor((F.col("_n") - window) / step))
    d = d.where(F.col("_n") >= window).withColumn("_a", first).withColumn("_z", last).where("_z >= _a")
    d = d.withColumn("window_id", F.explode(F.sequence("_a", "_z")))
    return d.groupBy(key, "window_id").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), (F.max_by("close", "day") / F.min_by("close", "day") - 1).alias("total_return"), F.count("*").alias("rows")
    )


def month_over_month(df: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """Month-end value against the month before, contributions of the month taken out."""
    m = df.groupBy("symbol", F.trunc("day", "month").alias("month")).agg(F.max_by("close", "day").alias("value"))
    if flows is not None:
        m = m.join(flows.groupBy("symbol", F.trunc("day", "month").alias("month")).agg(F.sum("amount").alias("flow")), ["symbol", "month"], "left")
    else:
        m = m.withColumn("flow", F.lit(0.0))
    return m.withColumn("change", (F.col("value") - F.coalesce("flow", F.lit(0.0))) / F.lag("value").over(by(order="month")) - 1)
