"""Dimensions and their change history (closed and open versions per key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import count_where, period
from .joins import differs

OPEN, BEGIN = "9999-12-31", "1970-01-01"


def scd2_init(src: DataFrame, dt: str) -> DataFrame:
    return src.withColumns({"start_time": F.lit(BEGIN), "end_time": F.lit(OPEN), "is_current": F.lit("Y"), "dt": F.lit(dt)})


def scd2_merge(prev: DataFrame, src: DataFrame, key: str, tracked: list[str], dt: str, deletes: DataFrame | None = None) -> DataFrame:
    """The snapshot of day dt from the one before and today's source.

    One full join of current rows with the source; each pair gives the versions that it needs (unchanged: the old one;
    changed: the old one closed and a new one; new key: a new one; key missing from the source: the old one, open
    unless `deletes`(key) names it). Closed rows are carried forward.
    """
    columns = [c for c in src.columns]
    yesterday = F.date_sub(F.lit(dt).cast("date"), 1).cast("string")
    gone = (deletes if deletes is not None else src.limit(0)).select(F.col(key).alias("_gone")).distinct()
    now = prev.filter("is_current = 'Y'").alias("p").join(src.alias("s"), F.col(f"p.{key}") == F.col(f"s.{key}"), "full").join(gone,
        F.col(f"p.{key}") == F.col("_gone"), "left")

    def version(side: str, start, end, current: str):
        return F.struct(*[F.col(f"{side}.{c}").alias(c) for c in columns], start.alias("start_time"), end.alias("end_time"),
            F.lit(current).alias("is_current"))

    old = version("p", F.col("p.start_time"), F.col("p.end_time"), "Y")
    closed = version("p", F.col("p.start_time"), yesterday, "N")
    new = version("s", F.lit(dt), F.lit(OPEN), "Y")
    rows = (F.when(F.col(f"p.{key}").isNull(), F.array(new)).when(F.col("_gone").isNotNull(), F.array(closed))
            .when(F.col(f"s.{key}").isNull(), F.array(old)).when(differs("p", "s", tracked), F.array(closed, new)).otherwise(F.array(old)))
    fresh = now.select(F.explode(rows).alias("v")).select("v.*")
    return fresh.unionByName(prev.filter("is_current = 'N'").select(fresh.columns)).withColumn("dt", F.lit(dt))


def day_of(seconds: Column) -> Column:
    """The UTC day of a time in seconds."""
    return F.date_add(F.lit(BEGIN).cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")


def daily_changes(changes: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The last change of each key and day (column `day`), by time and offset.

    Merging is this function again over a union, so any split of the changes into batches, in any order, comes to the same.
    """
    rows = changes if "day" in changes.columns else changes.withColumn("day", day_of(F.col(ts)))
    return rows.groupBy(key, "day").agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(ts), F.col("xoffset"), F.xxhash64(*rows.columns))).alias("r")).select("r.*")


def opened(prev: DataFrame, key: str) -> DataFrame:
    """The versions of a dimension table as the changes that lead to them, older than any other of their day."""
    own = [c for c in prev.columns if c not in ("start_time", "end_time", "is_current", "dt")]
    begins = prev.select(*own, F.lit("insert").alias("type"), F.lit(-1).cast("long").alias("ts"), F.lit(-1).cast("long").alias("xoffset"), F.col("start_time").alias("day"))
    ends = prev.filter("is_current = 'N'").select(
        *own, F.lit("delete").alias("type"), F.lit(-2).cast("long").alias("ts"), F.lit(-1).cast("long").alias("xoffset"), F.date_add(F.col("end_time").cast("date"), 1).cast("string").alias("day"))
    return begins.unionByName(ends)


def scd2_history(days: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """Versions as intervals from the last changes of each day.

    A day opens a version if it follows no version, a delete or other tracked values, and the next such day or delete
    ends it; a time without the key is a gap. Rows of a key are ordered by day, of which it has one row each.
    """
    own = [c for c in days.columns if c not in ("type", "ts", "xoffset", "day")]
    order = W.partitionBy(key).orderBy("day")
    gone = F.col("type") == "delete"
    before = F.lag(F.struct(gone.alias("gone"), F.struct(*tracked).alias("own"))).over(order)
    steps = days.withColumn("_before", before)
    new = F.col("_before").isNull() | (F.col("_before.gone") != gone) | (~gone & ~F.col("_before.own").eqNullSafe(F.struct(*tracked)))
    steps = steps.filter(new).withColumn("_next", F.lead("day").over(order)).filter(~gone)
    end = F.coalesce(F.date_sub(F.col("_next").cast("date"), 1).cast("string"), F.lit(OPEN))
    return steps.select(*own, F.col("day").alias("start_time"), end.alias("end_time"), F.when(F.col("_next").isNull(), "Y").otherwise("N").alias("is_current"))


def scd2_from_cdc(prev: DataFrame, changes: DataFrame, key: str, tracked: list[str], dt: str | None = None) -> DataFrame:
    """The dimension after change records (its columns plus type, ts, xoffset).

    With dt all records are changes of that day, and it is the snapshot's. Without it they are of the days of their own
    times, any number of them: changes before the newest version are put in their place, and the snapshot is of the last one's day.
    """
    columns = [c for c in prev.columns if c not in ("start_time", "end_time", "is_current", "dt")]
    more = changes.select(*columns, "type", F.col("ts").cast("long").alias("ts"), F.col("xoffset").cast("long").alias("xoffset"))
    more = more.withColumn("day", day_of(F.col("ts")) if dt is None else F.lit(dt))
    out = scd2_history(daily_changes(opened(prev, key).unionByName(daily_changes(more, key)), key), key, tracked)
    if dt is not None:
        return out.withColumn("dt", F.lit(dt))
    return out.crossJoin(F.broadcast(more.agg(F.max("day").alias("dt"))))  # one row


def scd2_check(df: DataFrame, key: str, src: DataFrame | None = None, tracked: list[str] | None = None) -> DataFrame:
    """rule, violations: closed rows with the open end, open rows with another end, keys with two current rows, current rows unlike the source."""
    one = df.agg(count_where((F.col("is_current") == "N") & (F.col("end_time") == OPEN)).alias("closed_with_open_end"),
                 count_where((F.col("is_current") == "Y") & (F.col("end_time") != OPEN)).alias("open_with_end"))
    twice = df.filter("is_current = 'Y'").groupBy(key, "dt").count().filter("count > 1").agg(F.count("*").alias("two_current"))
    out = one.crossJoin(twice)
    if src is not None:
        cur = df.filter("is_current = 'Y'").alias("a").join(src.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "right")
        out = out.crossJoin(cur.agg(count_where(F.col(f"a.{key}").isNull() | differs("a", "b", tracked or [key])).alias("unlike_source")))
    return out.unpivot([], out.columns, "rule", "violations")


def current(df: DataFrame) -> DataFrame:
    return df.filter("is_current = 'Y'")


def date_hours(spark: SparkSession, start: str, end: str) -> DataFrame:
    """A row for each hour of the days from start to end."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))
    rows = days.crossJoin(spark.range(24).select(F.col("id").cast("int").alias("hour")))
    return rows.select(
        F.col("d").cast("string").alias("date_key"), F.year("d").alias("year"), F.quarter("d").alias("quarter"), F.month("d").alias("month"),
            F.dayofmonth("d").alias("day"),
        F.weekofyear("d").alias("week"), (F.weekday("d") + 1).alias("weekday"), F.date_format("d", "EEEE").alias("weekday_name"),
            F.when(F.weekday("d") >= 5, 1).otherwise(0).alias("is_weekend"), "hour", period(F.col("hour")).alias("peak_period"))


def load_dimension(src: DataFrame) -> DataFrame:
    """The rows of the newest dt, once each."""
    newest = src.agg(F.max("dt").alias("_dt"))
    return src.join(F.broadcast(newest), F.col("dt") == F.col("_dt")).drop("_dt", "dt").distinct()
