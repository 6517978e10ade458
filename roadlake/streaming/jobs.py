"""Streaming jobs: event-time windows, alert formatting, late rows, repair, serving views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import mean, rounded
from ..operators.clean import dedup
from ..operators.dims import daily_changes, scd2_history
from ..plans.warehouse import dws_road_hour_flow
from ..sources.io import write_dt
from ..sources.shared import cut
from .serving import BUCKETS, _children, drop_versions, finished, keep_recent, latest_version, newest, read_latest, read_recent, read_table, recent, upsert_latest  # noqa: F401


def road_counts(df: DataFrame, minutes: int = 5, delay: str | None = "30 seconds", ts: str = "pass_time") -> DataFrame:
    """Passes per road and tumbling window; idle partitions of a source do not hold the watermark back. delay: None for a stream with a watermark."""
    rows = df.withWatermark(ts, delay) if df.isStreaming and delay is not None else df
    out = rows.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), "road_id").agg(F.count("*").alias("n"),
        F.sum("speed").cast("long").alias("total_speed"), rounded(mean(F.col("speed"))).alias("avg_speed"))
    return out.select(F.col("w.start").alias("window_start"), "road_id", "n", "total_speed", "avg_speed")


def road_congestion(df: DataFrame, minutes: int = 5, delay: str = "30 seconds", ts: str = "sample_time") -> DataFrame:
    rows = df.withWatermark(ts, delay) if df.isStreaming else df
    out = rows.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), "road_id").agg(F.min("avg_speed").alias("min_speed"),
        F.sum("traffic_flow").cast("long").alias("flow"), F.max("congestion_rate").alias("max_rate"), F.min(ts).alias("first_time"))
    return out.select(F.col("w.start").alias("window_start"), "road_id", "min_speed", "flow", "max_rate", "first_time")


def dedup_minute(df: DataFrame, ts: str = "pass_time", delay: str = "30 seconds") -> DataFrame:
    """One row for each device, road, type and minute, with a validity flag: the first of the minute, of one time by the other columns; a stream keeps the first to come."""
    rows = df.withColumn("minute", F.date_trunc("minute", ts)).withColumn("is_valid",
        F.coalesce(F.col("speed").between(0, 200) & F.col("road_id").isNotNull(), F.lit(False)))
    keys = ["device_id", "road_id", "vehicle_type", "minute"]
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else dedup(rows, keys, [ts, *[c for c in df.columns if c not in (*keys, ts)]])


def united(streams: list[tuple[DataFrame, str, str]], policy: str = "min") -> DataFrame:
    """One stream of several (stream, time column, delay), each with a watermark of its own; all have the columns of the first.

    policy min: a window closes when the watermarks of all streams have passed it, so a stream that lags, or one that has
    been idle, holds windows back and none of its rows is late. max: the leading stream alone closes windows; an idle one
    does not hold them back, and rows of a slow one may be late. The session's setting is read when a query starts, and a
    query keeps it over restarts.
    """
    if policy not in ("min", "max"):
        raise ValueError(f"{policy} is neither min nor max")
    streams[0][0].sparkSession.conf.set("spark.sql.streaming.multipleWatermarkPolicy", policy)
    name = streams[0][1]
    marked = [s.withColumnRenamed(ts, name).withWatermark(name, delay) if s.isStreaming else s.withColumnRenamed(ts, name) for s, ts, delay in streams]
    out = marked[0]
    for more in marked[1:]:
        out = out.unionByName(more)
    return out


def split_late(batch: DataFrame, watermark, ts: str) -> tuple[DataFrame, DataFrame]:
    """Rows in time and rows older than the watermark, for T+1 repair."""
    late = F.coalesce(F.col(ts) < F.lit(watermark), F.lit(False))
    return batch.filter(~late), batch.filter(late)


def tee_late(path_on_time: str, path_late: str, ts: str, delay_seconds: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes rows older than the watermark apart, from one reading of the batch.

    Each batch writes to its own folder by overwrite, so a repeated batch does not double rows. The greatest time seen up
    to a batch lies beside the rows, so a restarted job goes on with the watermark that it had.
    """
    marks = f"{path_on_time}_marks"

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = latest_version(spark, marks, batch_id)
        seen = None if last is None else spark.read.parquet(f"{marks}/version={last}").first()[0]
        batch = batch.persist()
        try:
            if seen is None:
                good, late = batch, batch.limit(0)
            else:
                good, late = split_late(batch, seen - dt.timedelta(seconds=delay_seconds), ts)
            good.write.mode("overwrite").parquet(f"{path_on_time}/batch={batch_id}")
            late.write.mode("overwrite").parquet(f"{path_late}/batch={batch_id}")
            mark = batch.agg(F.greatest(F.max(ts), F.lit(seen).cast("timestamp")).alias("seen"))
            mark.write.mode("overwrite").parquet(f"{marks}/version={batch_id}")
        finally:
            batch.unpersist()
        drop_versions(spark, marks, batch_id)

    return sink


def repair_hours(detail: DataFrame, late: DataFrame) -> DataFrame:
    """The hour table of the days that late rows touch, from the detail rows with them; of rows of one pass the first counts."""
    days = late.select("dt").distinct()
    rows = detail.join(days, "dt", "left_semi").unionByName(late)
    return dws_road_hour_flow(dedup(rows, ["vehicle_id", "pass_time"]))


def repair_late(spark: SparkSession, path_late: str, path_detail: str, path_hours: str, format: str = "orc") -> list[int]:
    """Takes the late batches that no earlier run has taken into the detail table and makes the hours of their days anew.

    Only the days that they touch are read and overwritten. The ledger of taken batches (`<path_late>_taken`) is written
    last: a run that fails before that is repeated with the same result, since of rows of one pass the first counts.
    Returns the batches taken. Rows without a day stay in the late folder's batch and are in no table.
    """
    ledger = f"{path_late}_taken"
    last = latest_version(spark, ledger)
    taken = set() if last is None else {r["batch"] for r in spark.read.parquet(f"{ledger}/version={last}").collect()}
    found = [n for n in _children(spark, path_late, "batch=") if finished(spark, f"{path_late}/{n}")]
    todo = sorted(b for b in (int(n.split("=")[1]) for n in found) if b not in taken)
    if not todo:
        return []
    late = spark.read.parquet(*[f"{path_late}/batch={b}" for b in todo])
    detail = spark.read.format(format).load(path_detail)
    late = late.filter("dt is not null").select(*[F.col(c).cast(detail.schema[c].dataType).alias(c) for c in detail.columns])
    days = [r["dt"] for r in late.select("dt").distinct().collect()]  # the days that late rows touch
    if days:
        rows = dedup(detail.filter(F.col("dt").isin(days)).unionByName(late), ["vehicle_id", "pass_time"])
        rows = cut(rows)  # the days are read before they are overwritten
        write_dt(rows, path_detail, format)
        write_dt(dws_road_hour_flow(rows), path_hours, format)
    spark.createDataFrame([(b,) for b in sorted(taken | set(todo))], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{ledger}/version={max(todo)}")
    drop_versions(spark, ledger, max(todo))
    return todo


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Runs a foreachBatch sink with a checkpoint; exactly-once for sinks that are idempotent by batch id."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation",
        checkpoint).trigger(**(trigger or {"processingTime": "5 minutes"})).start()


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs what the source has now into Parquet files, from where the checkpoint stands; the file sink is exactly-once."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def cdc_snapshots(path: str, key: str, tracked: list[str], columns: str | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A sink for decoded change records that keeps a dimension's history, one snapshot for each batch.

    The last change of each key and day is kept in a latest-value table beside the snapshots (`<path>_changes`), and the
    history is made from it; so changes may come in batches of any days and in any order. columns: those of the
    dimension, as a schema (default: all of the records but type, ts, xid, xoffset). A repeated batch starts from what was before it.
    """
    names = None if columns is None else [part.split()[0] for part in columns.split(",")]
    changes = f"{path}_changes"

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = names or [c for c in batch.columns if c not in ("type", "ts", "xid", "xoffset")]
        days = daily_changes(batch.select(*own, "type", "ts", "xoffset"), key)
        upsert_latest(changes, [key, "day"], ["ts", "xoffset"], buckets)(days, batch_id)
        kept = read_table(spark, changes, [key, "day"], ["ts", "xoffset"], batch_id)
        if kept is None:
            return
        out = scd2_history(kept, key, tracked).crossJoin(F.broadcast(kept.agg(F.max("day").alias("dt"))))  # one row
        out.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        drop_versions(spark, path, batch_id)

    return sink


def ranked(df: DataFrame, score: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(score), *[c for c in df.columns if c != score][:1]).limit(n)


def counters(df: DataFrame, ts: str) -> DataFrame:
    """Rows per day; as a stream in complete mode, a running counter."""
    return df.groupBy(F.to_date(ts).cast("string").alias("day")).agg(F.count("*").alias("n"))


def city_overview(roads: DataFrame, devices: DataFrame) -> DataFrame:
    """One row for the serving page from the two latest-value views."""
    a = roads.agg(F.count("*").alias("roads"), F.sum("n").cast("long").alias("vehicles"), rounded(F.avg("avg_speed")).alias("avg_speed"))
    return a.crossJoin(devices.agg(F.count("*").alias("devices"),
        F.sum(F.when(F.col("online_flag") == "ONLINE", 1).otherwise(0)).cast("long").alias("online")))


def quality_status(results: DataFrame) -> DataFrame:
    """One row: the mean rate of each kind of check, the backlog and the newest day of the check results."""
    rate = lambda kind: rounded(F.avg(F.when(F.col("check_type") == kind, F.col("rate").cast("decimal(10,2)"))))
    return results.agg(
        *[rate(k).alias(f"{k}_rate") for k in ("completeness", "uniqueness", "validity")],
        F.sum(F.when(F.col("check_type") == "backlog", F.col("value"))).cast("long").alias("backlog"), F.max("dt").alias("last_check"))


def payload(overview: DataFrame, quality: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """One row with the JSON of a serving page: two one-row views, and lists (each cut to its length before) by name."""
    out = overview.select(F.struct(*overview.columns).alias("city_overview")).crossJoin(quality.select(F.struct(*quality.columns).alias("quality")))
    for name, rows in lists.items():
        out = out.crossJoin(rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name)))
    return out.select(F.to_json(F.struct(*out.columns)).alias("payload"))


def one(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(F.col(key) == value)


def by_count(df: DataFrame, n: int | None = None) -> DataFrame:
    rows = df.orderBy(F.desc("n"), "road_id")
    return rows if n is None else rows.limit(n)
