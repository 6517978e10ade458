"""Registers the batch forms of stream jobs and serving views with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dims, quality
from ..sources import io
from ..sources.shared import shared_dir
from ..streaming import backlog, jobs
from .oracle import big, cnt, mean, r
from .registry import add


@add("r3_road_counts", f"""
select time_bucket(interval 5 minute, pass_time) as window_start, road_id, count(*) as n, {big('sum(speed)')} as total_speed,
  {r(mean('speed'))} as avg_speed
from dwd_vehicle_pass group by 1, 2
""")
def _(t):
    return jobs.road_counts(t["dwd_vehicle_pass"])


@add("r4_road_congestion", f"""
select time_bucket(interval 5 minute, sample_time) as window_start, road_id, min(avg_speed) as min_speed, {big('sum(traffic_flow)')} as flow,
  cast(max(congestion_rate) as double) as max_rate, min(sample_time) as first_time
from dwd_traffic_status group by 1, 2
""")
def _(t):
    return jobs.road_congestion(t["dwd_traffic_status"])


@add("r17_dedup_minute", """
select device_id, road_id, vehicle_type, date_trunc('minute', cast(pass_time as timestamp)) as minute,
  coalesce(try_cast(speed as int) between 0 and 200 and road_id is not null, false) as is_valid
from vehicle_pass
qualify row_number() over (partition by device_id, road_id, vehicle_type, date_trunc('minute', cast(pass_time as timestamp))
  order by cast(pass_time as timestamp), vehicle_id nulls first, try_cast(speed as int) nulls first, direction nulls first, lane, dt) = 1
""")
def _(t):
    rows = t["vehicle_pass"].withColumns({"pass_time": F.col("pass_time").cast("timestamp"), "speed": F.expr("try_cast(speed as int)")})
    rows = rows.select("vehicle_id", "road_id", "device_id", "pass_time", "speed", "direction", "vehicle_type", "lane", "dt")
    return jobs.dedup_minute(rows).select("device_id", "road_id", "vehicle_type", "minute", "is_valid")


@add("r16_repair_hours", f"""
select road_id, hour, dt, count(*) as traffic_count, {big('sum(speed)')} as total_speed, {r(mean('speed'))} as avg_speed,
  {', '.join(f'{cnt(f"vehicle_type = {k!r}")} as {k.lower()}_car_cnt' for k in ('SMALL', 'MEDIUM', 'LARGE', 'OTHER'))}
from dwd_vehicle_pass where dt in (select dt
  from dwd_vehicle_pass where hour = 23)
group by road_id, hour, dt
""")
def _(t):
    return jobs.repair_hours(t["dwd_vehicle_pass"].filter("hour < 23"), t["dwd_vehicle_pass"].filter("hour = 23"))


@add("s12_latest_device", """
select * exclude (k, cpu_usage, memory_usage, temperature), cast(cpu_usage as double) as cpu_usage
from (select *, row_number() over (partition by device_id order by heartbeat_time desc) as k
  from dwd_device_status) where k = 1
""")
def _(t):
    return jobs.newest(t["dwd_device_status"], "device_id", "heartbeat_time").drop("memory_usage", "temperature")


@add("s13_recent_alarms", """
select alarm_id, alarm_level, alarm_time
from dwd_alarm_log order by alarm_time desc, alarm_id, alarm_level limit 100
""")
def _(t):
    return jobs.recent(t["dwd_alarm_log"].select("alarm_id", "alarm_level", "alarm_time"), 100, "alarm_time")


@add("s14_busiest_roads", "select road_id, count(*) as n from dwd_vehicle_pass group by road_id order by n desc, road_id limit 10")
def _(t):
    return jobs.ranked(t["dwd_vehicle_pass"].groupBy("road_id").agg(F.count("*").alias("n")), "n", 10)


@add("s15_counters", "select cast(cast(alarm_time as date) as varchar) as day, count(*) as n from dwd_alarm_log group by 1")
def _(t):
    return jobs.counters(t["dwd_alarm_log"], "alarm_time")


@add("s16_city_overview", f"""
select * from (select count(*) as roads, {big('sum(n)')} as vehicles, {r('avg(avg_speed)')} as avg_speed
  from (select road_id, count(*) as n, {r(mean('speed'))} as avg_speed
    from dwd_vehicle_pass group by road_id))
cross join (select count(*) as devices, {cnt('''online_flag = 'ONLINE' ''')} as online
  from (select *, row_number() over (partition by device_id order by heartbeat_time desc) as k
    from dwd_device_status) where k = 1)
""")
def _(t):
    return jobs.city_overview(t["dwd_vehicle_pass"].groupBy("road_id").agg(F.count("*").alias("n"),
        F.round(F.sum("speed").cast("double") / F.count("speed") + F.lit(1e-9), 2).alias("avg_speed")),
            jobs.newest(t["dwd_device_status"], "device_id", "heartbeat_time"))


_CHANGES = "select 'R' || cast(s_suppkey as varchar) as road_id, case s_suppkey % 3 when 0 then 'insert' when 1 then 'update' else 'delete' end as type from supplier where s_suppkey % 2 = 0"


@add("d3_scd2_from_cdc", """
select road_id, coalesce(case when type <> 'delete' and v = 2 then speed_limit + 5 end, speed_limit) as speed_limit, case when v = 1
  then '1970-01-01' else '2024-06-08' end as start_time,
 case when v = 1 and type is not null then '2024-06-07' else '9999-12-31' end as end_time, case when v = 1 and type is not null then 'N'
   else 'Y' end as is_current
from (select road_id, speed_limit, type
  from road left join changes using (road_id))
cross join (values (1), (2)) x(v)
where v = 1 or type in ('insert', 'update')
""", changes=_CHANGES)
def _(t):
    return _from_cdc(t)


def _from_cdc(t):
    road = t["road"].select("road_id", "speed_limit")
    n = F.substring("road_id", 2, 20).cast("int")
    kind = F.when(n % 3 == 0, "insert").when(n % 3 == 1, "update").otherwise("delete")
    last = road.filter(n % 2 == 0).select("road_id", (F.col("speed_limit") + 5).alias("speed_limit"), kind.alias("type"),
        F.lit(1717804802).cast("long").alias("ts"), F.lit(1).cast("long").alias("xoffset"))
    stale = last.withColumns({"ts": F.lit(1717804801).cast("long"), "type": F.lit("delete"), "speed_limit": F.lit(-1)})
    return dims.scd2_from_cdc(dims.scd2_init(road, "2024-06-07"), last.unionByName(stale), "road_id", ["speed_limit"], "2024-06-08").drop("dt")


def _batches(df: DataFrame, sink, parts: int = 3) -> None:
    """Hands the rows of df to a foreachBatch sink in batches by a hash of the row, the last one twice, as after a restart."""
    for i in [*range(parts), parts - 1]:
        sink(df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(parts)) == i), i)


def _folder(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/serving-{uuid.uuid4().hex}"


_LEVELS = """
select road_id, cast(cast(sample_time as date) as varchar) as day, sample_time, max(jam_level) % 3 as level, max(jam_level) % 4 = 3 as gone
from traffic_status group by road_id, sample_time
"""
_LAST = "select * from levels qualify row_number() over (partition by road_id, day order by sample_time desc) = 1"
_STEPS = """
select *, lag(gone) over w as was_gone, lag(level) over w as was from days window w as (partition by road_id order by day)
qualify was_gone is null or was_gone <> gone or (not gone and was <> level)
"""


@add("d3_scd2_history", """
select road_id, level, day as start_time, coalesce(cast(cast(next_day as date) - 1 as varchar), '9999-12-31') as end_time,
  case when next_day is null then 'Y' else 'N' end as is_current
from (select *, lead(day) over (partition by road_id order by day) as next_day from steps) where not gone
""", levels=_LEVELS, days=_LAST, steps=_STEPS)
def _(t):
    rows = t["traffic_status"].groupBy("road_id", "sample_time").agg(F.max("jam_level").alias("jam"))
    changes = rows.select("road_id", (F.col("jam") % 3).alias("level"), F.when(F.col("jam") % 4 == 3, "delete").otherwise("update").alias("type"),
        F.unix_timestamp("sample_time").alias("ts"), F.lit(0).cast("long").alias("xoffset"))
    path = _folder(changes)
    _batches(changes, jobs.cdc_snapshots(path, "road_id", ["level"], buckets=4))
    return rows.sparkSession.read.parquet(f"{path}/version=2").drop("dt")


_NEWEST = """
select device_id, max(heartbeat_time) as heartbeat_time, max_by(signal_strength, heartbeat_time) as signal_strength
from (select device_id, heartbeat_time, max(signal_strength) as signal_strength from device_status group by 1, 2) group by 1
"""


def _device_table(t) -> str:
    rows = t["device_status"].groupBy("device_id", "heartbeat_time").agg(F.max("signal_strength").alias("signal_strength"))
    path = _folder(rows)
    _batches(rows, jobs.upsert_latest(path, "device_id", "heartbeat_time", buckets=4, most_folders=2), 4)
    return path


@add("s12_latest_table", "select * from newest", newest=_NEWEST)
def _(t):
    return jobs.read_table(t["device_status"].sparkSession, _device_table(t), "device_id", "heartbeat_time")


@add("s12_latest_within_ttl", """
select * from newest where (select epoch(max(heartbeat_time)) from newest) - epoch(heartbeat_time) < 21600
""", newest=_NEWEST)
def _(t):
    """Devices with a heartbeat in the last six hours of the data."""
    path, spark = _device_table(t), t["device_status"].sparkSession
    as_of = t["device_status"].agg(F.max("heartbeat_time").cast("string")).first()[0]
    return jobs.read_latest(spark, path, 21600, as_of, "heartbeat_time", "device_id")


@add("s13_recent_kept", """
select alarm_id, alarm_level, alarm_time
from dwd_alarm_log order by alarm_time desc, alarm_id, alarm_level limit 100
""")
def _(t):
    rows = t["dwd_alarm_log"].select("alarm_id", "alarm_level", "alarm_time")
    path = _folder(rows)
    _batches(rows, jobs.keep_recent(path, 100, "alarm_time"))
    return jobs.read_recent(rows.sparkSession, path, "alarm_time")


@add("r16_late_to_hours", f"""
select road_id, hour, dt, count(*) as traffic_count, {big('sum(speed)')} as total_speed, {r(mean('speed'))} as avg_speed,
  {', '.join(f'{cnt(f"vehicle_type = {k!r}")} as {k.lower()}_car_cnt' for k in ('SMALL', 'MEDIUM', 'LARGE', 'OTHER'))}
from dwd_vehicle_pass group by road_id, hour, dt
""")
def _(t):
    """Rows before 20 o'clock are the tables; the others come late, over a late sink, and are repaired twice."""
    rows = t["dwd_vehicle_pass"]
    spark, path = rows.sparkSession, _folder(rows)
    on_time = rows.filter("hour < 20")
    io.write_dt(on_time, f"{path}/detail", "parquet")
    io.write_dt(jobs.dws_road_hour_flow(on_time), f"{path}/hours", "parquet")
    tee = jobs.tee_late(f"{path}/in_time", f"{path}/late", "pass_time", 30)
    tee(rows.select(*[F.lit("2100-01-01 00:00:00").cast("timestamp").alias(c) if c == "pass_time" else c for c in rows.columns]).limit(1), 0)
    tee(rows.filter("hour >= 20"), 1)
    for _ in range(2):
        jobs.repair_late(spark, f"{path}/late", f"{path}/detail", f"{path}/hours", "parquet")
    return spark.read.parquet(f"{path}/hours").select("road_id", "hour", F.col("dt").cast("string").alias("dt"), "traffic_count", "total_speed", "avg_speed", *[f"{k}_car_cnt" for k in ("small", "medium", "large", "other")])


@add("k4_stream_backlog", """
select 'backlog' as check_type, 'alarms' as table_name, '2024-06-08' as dt, 'lag' as metric, lag as value, cast(lag as double) as rate,
  cast(null as double) as row_rate, case when lag < 1000 then 'PASS' when lag < 10000 then 'WARN' else 'FAIL' end as status
from (select count(*) as lag from alarm_log where cast(substr(alarm_id, 2) as bigint) % 3 = 0)
""")
def _(t):
    """A stream that was stopped, and input that came after."""
    rows = t["alarm_log"].select("alarm_id", "device_id")
    spark, path = rows.sparkSession, _folder(rows)
    late = F.substring("alarm_id", 2, 20).cast("long") % 3 == 0
    rows.filter(~late).write.parquet(f"{path}/alarms")
    jobs.run_available(spark.readStream.schema(rows.schema).parquet(f"{path}/alarms"), f"{path}/out", f"{path}/checkpoint")
    rows.filter(late).write.mode("append").parquet(f"{path}/alarms")
    return quality.backlog(backlog.file_backlog(spark, f"{path}/checkpoint", f"{path}/alarms", "2024-06-08"), "alarms")
