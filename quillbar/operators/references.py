"""References to records that do not exist.

Parents and children of every relation are tagged and united in long form
(parent table, key, tag, time); one aggregation per (parent table, key) says
whether a parent is there and since when. Groups that lack the parent flag, or
whose parent came later than their earliest child, are kept and their children
are read off by a join on the key; counts are summed by period.

Scale: the aggregation combines before the shuffle, so a key that holds a third
of all rows costs one row per task. The join back replicates only the suspect
keys over ``SALTS`` shares and spreads the children of a hot key over them.
Nothing is broadcast and no group is collected.

Defined results: a null or blank reference is no reference; a null child time
is not compared (only a parent that is missing altogether counts); a parent
whose times are all null is not compared either; exact copies of a child give
one row; empty tables give empty results (with an empty parent table every
reference is an orphan); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbar.sources.tables import key_text

SALTS = 16
_SEP = "\x01"
_NEVER, _ALWAYS = 2**62, -(2**62)


def parents(df: DataFrame, name: str, key: Column, since: Column | None = None) -> DataFrame:
    """Parent rows of one relation in long form, one per key before the shuffle.
    ``since``: microseconds from which the record is there; null is always."""
    t = F.lit(None).cast("bigint") if since is None else since
    return (
        df.select(F.lit(name).alias("parent_table"), key.alias("key"), t.alias("t"))
        .where("key is not null")
        .groupBy("parent_table", "key")
        .agg(F.coalesce(F.min("t"), F.lit(_ALWAYS)).alias("since"))
    )


def children(df: DataFrame, ref_table: str, parent_table: str, ref_id: Column, key: Column, as_of: Column, period: Column) -> DataFrame:
    """Child rows of one relation in long form; null keys are no reference."""
    return df.select(
        F.lit(ref_table).alias("ref_table"), F.lit(parent_table).alias("parent_table"), ref_id.alias("ref_id"), key.alias("key"),
        F.coalesce(as_of, F.lit(_NEVER)).alias("as_of"), period.alias("period"),
    ).where("key is not null")


def find_orphans(parent_rows: DataFrame, child_rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(ref_table, ref_id, parent_table, key, period) of every child without a parent in time."""
    long = parent_rows.select("parent_table", "key", "since", F.lit(None).cast("bigint").alias("as_of")).unionByName(
        child_rows.select("parent_table", "key", F.lit(None).cast("bigint").alias("since"), "as_of")
    )
    suspects = (
        long.groupBy("parent_table", "key")
        .agg(F.min("since").alias("since"), F.min("as_of").alias("first_child"))
        .where("first_child is not null and (since is null or since > first_child)")
        .select("parent_table", "key", "since", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    spread = child_rows.withColumn("salt", F.pmod(F.xxhash64("ref_id"), F.lit(salts)).cast("int"))
    return (
        spread.join(suspects, ["parent_table", "key", "salt"])
        .where("since is null or since > as_of")
        .select("ref_table", "ref_id", "parent_table", "key", "period")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans and distinct missing keys per referring table and period. Two
    levels: first per key, then per period. An id that occurs with several keys
    or periods counts once with each."""
    one = orphans.distinct().groupBy("ref_table", "period", "parent_table", "key").agg(F.count("*").alias("n"))
    return one.groupBy("ref_table", "period").agg(F.sum("n").alias("orphans"), F.count("*").alias("missing_keys"))


def _month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def market_orphans(jobs: DataFrame, items: DataFrame, instruments: DataFrame, orders: DataFrame, loaded: DataFrame) -> DataFrame:
    """The three relations of the platform's tables: items to jobs, orders to the
    instrument snapshot in force, CDS instruments to the loaded contract file."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ex_sym = F.concat_ws(_SEP, key_text("exchange"), key_text("symbol"))
    both = key_text("exchange").isNotNull() & key_text("symbol").isNotNull()

    # snapshot dates: one per delivery, so the array stays small (a few thousand for decades of daily snapshots)
    days = instruments.agg(F.sort_array(F.collect_set("snapshot_date"))).scalar()
    in_force = F.coalesce(
        F.array_max(F.filter("_days", lambda d: d <= F.to_date("order_timestamp"))).cast("string"),
        F.when(F.col("order_timestamp").isNull(), "any").otherwise("none"),
    )
    snap_keys = instruments.where(both).select(
        F.explode(F.array(F.col("snapshot_date").cast("string"), F.lit("any"))).alias("snap"), ex_sym.alias("es")
    )
    p = (
        parents(jobs, "download_jobs", key_text("id"), micros("created_at"))
        .unionByName(parents(snap_keys, "symtoken", F.concat(F.col("snap"), F.lit(_SEP), F.col("es"))))
        .unionByName(parents(loaded, "cds_symbols", key_text("token"), micros("file_date")))
    )
    cds = instruments.where(key_text("exchange") == "CDS")
    c = (
        children(items, "job_items", "download_jobs", F.col("id"), key_text("job_id"), micros("started_at"), _month("started_at"))
        .unionByName(
            children(
                orders.withColumn("_days", days), "sandbox_orders", "symtoken", F.col("id"),
                F.when(both, F.concat(in_force, F.lit(_SEP), ex_sym)), F.lit(None).cast("bigint"), _month("order_timestamp"),
            )
        )
        .unionByName(children(cds, "symtoken", "cds_symbols", F.col("id"), key_text("token"), micros("snapshot_date"), _month("snapshot_date")))
    )
    return find_orphans(p, c)
