"""Role views: traffic inputs over the star-schema tables.

The same SQL runs in Spark (as temp views) and in DuckDB (as CTEs).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {
    "area": """
select concat('A', n_nationkey) as area_id, n_name as area_name, concat('C', n_regionkey) as city_id, r_name as city_name
from nation join region on n_regionkey = r_regionkey
""",
    "road": """
select concat('R', s_suppkey) as road_id, s_name as road_name,
  case s_suppkey % 4 when 0 then 'ARTERIAL' when 1 then 'EXPRESS' when 2 then 'BRANCH' else 'HIGHWAY' end as road_type,
  cast(s_suppkey % 6 + 2 as int) as lane_count, cast(s_suppkey % 5 * 20 + 40 as int) as speed_limit,
  concat('A', s_nationkey) as area_id
from supplier
""",
    "device": """
select concat('D', c_custkey) as device_id, c_name as device_name,
  case c_custkey % 4 when 0 then 'CAMERA' when 1 then 'SENSOR' when 2 then 'RADAR' else 'GATE' end as device_type,
  c_mktsegment as manufacturer, concat('R', c_custkey % (select count(*) from supplier) + (select min(s_suppkey) from supplier)) as road_id
from customer
""",
    "vehicle_pass": """
select case when event_id % 97 = 0 then null else concat('V', user_id) end as vehicle_id,
  case when event_id % 10 < 6 then concat('R', event_id % 3 + (select min(s_suppkey) from supplier)) else concat('R', event_id % (select count(*) from supplier) + (select min(s_suppkey) from supplier)) end as road_id,
  concat('D', user_id) as device_id,
  cast(date_trunc('second', ts) as string) as pass_time,
  case when event_id % 89 = 0 then 'bad' else cast(cast(floor(value) as int) as string) end as speed,
  case event_id % 5 when 0 then 'N' when 1 then 'S' when 2 then 'E' when 3 then 'W' end as direction,
  case event_type when 'click' then 'SMALL' when 'view' then 'MEDIUM' when 'purchase' then 'LARGE' else event_type end as vehicle_type,
  cast(event_id % 4 + 1 as int) as lane, cast(cast(ts as date) as string) as dt
from (select * from events union all select event_id + 1, ts, user_id, event_type, value, props from events where event_id % 20 = 0) e
""",
    "traffic_status": """
select concat('R', event_id % (select count(*) from supplier) + (select min(s_suppkey) from supplier)) as road_id, cast(event_id % 90 as int) as avg_speed,
  cast((event_id * 17) % 5200 as int) as traffic_flow, cast(event_id % 7 as int) as jam_level,
  cast((event_id * 41) % 10400 / 100.0 as decimal(5,2)) as congestion_rate,
  case event_id % 4 when 0 then 'PEAK_HOUR' when 1 then 'NORMAL' when 2 then 'OFF_PEAK' else 'odd' end as peak_flag,
  date_trunc('second', ts) as sample_time, cast(cast(ts as date) as string) as dt
from events
""",
    "device_status": """
select concat('D', user_id) as device_id, cast((event_id * 37) % 10500 / 100.0 as decimal(5,2)) as cpu_usage,
  cast((event_id * 53) % 10000 / 100.0 as decimal(5,2)) as memory_usage, cast((event_id * 29) % 1100 / 10.0 as decimal(4,1)) as temperature,
  case event_type when 'error' then 'OFFLINE' when 'signup' then 'odd' else 'ONLINE' end as online_flag,
  date_trunc('second', ts) as heartbeat_time, cast(-30 - event_id % 70 as int) as signal_strength, cast(cast(ts as date) as string) as dt
from events
""",
    "alarm_log": """
select concat('L', event_id) as alarm_id, concat('D', user_id) as device_id,
  case event_id % 7 when 0 then 'OFFLINE' when 1 then 'CPU_HIGH' when 2 then 'MEMORY_HIGH' when 3 then 'TEMP_HIGH' when 4 then 'SIGNAL_WEAK' when 5 then 'HARDWARE_FAULT' else 'odd' end as alarm_type,
  case event_id % 5 when 0 then 'CRITICAL' when 1 then 'MAJOR' when 2 then 'MINOR' when 3 then 'WARNING' else 'odd' end as alarm_level,
  props as alarm_content, date_trunc('second', ts) as alarm_time,
  case when event_id % 3 <> 0 then date_trunc('second', ts) + interval '45' minute end as recover_time,
  case when event_id % 3 <> 0 then 'RECOVERED' else 'UNRECOVERED' end as recover_status, cast(cast(ts as date) as string) as dt
from (select * from events where event_type = 'error' union all
      select event_id + 7, ts + interval '40' second, user_id, event_type, value, props from events where event_type = 'error' and event_id % 2 = 0) e
""",
    # Dense views: an hour of heartbeats and alarms, so that rules of minutes have matches.
    "device_pulse": """
select concat('D', user_id) as device_id, cast((event_id * 37) % 10500 / 100.0 as decimal(5,2)) as cpu_usage,
  cast((event_id * 53) % 10000 / 100.0 as decimal(5,2)) as memory_usage, cast((event_id * 29) % 1100 / 10.0 as decimal(4,1)) as temperature,
  case event_type when 'error' then 'OFFLINE' when 'signup' then 'OFFLINE' else 'ONLINE' end as online_flag,
  timestamp '2024-06-08 10:00:00' + interval '1' second * cast((event_id * 3671) % 4321 as int) as heartbeat_time,
  cast(-30 - event_id % 70 as int) as signal_strength, '2024-06-08' as dt
from events
""",
    "status_pulse": """
select concat('R', event_id % 5) as road_id, case when ((event_id * 3671) % 14407 + event_id % 5 * 700) % (3000 + event_id % 5 * 1000) < 400 then 2 else 5 end as jam_level,
  timestamp '2024-06-08 10:00:00' + interval '1' second * cast((event_id * 3671) % 14407 as int) as sample_time
from events
""",
    "alarm_pulse": """
select concat('L', event_id) as alarm_id, concat('D', user_id % 7) as device_id,
  case event_id % 3 when 0 then 'OFFLINE' when 1 then 'CPU_HIGH' else 'TEMP_HIGH' end as alarm_type,
  case event_id % 4 when 0 then 'CRITICAL' when 1 then 'MAJOR' when 2 then 'MINOR' else 'WARNING' end as alarm_level,
  timestamp '2024-06-08 10:00:00' + interval '1' second * cast((event_id * 3671) % 7207 as int) as alarm_time, '2024-06-08' as dt
from events where event_type = 'error'
""",
    # Feeds as the topics carry them: delimited text, JSON and change records.
    "status_text": """
select concat_ws('\t', road_id, cast(avg_speed as string), cast(traffic_flow as string), cast(jam_level as string), cast(congestion_rate as string), peak_flag, cast(sample_time as string)) as value, dt
from traffic_status
""",
    "status_json": """
select concat('{"road_id": "', road_id, '", "avg_speed": ', cast(avg_speed as string), ', "jam_level": ', cast(jam_level as string), '}') as value from traffic_status
""",
    "road_changes": """
select concat('{"database": "traffic", "table": "', case when s_suppkey % 9 = 0 then 'other' else 'road' end, '", "type": "',
  case s_suppkey % 5 when 0 then 'delete' when 1 then 'insert' else 'update' end, '", "ts": ', cast(1717804800 + s_suppkey as string), ', "xid": 1, "xoffset": ', cast(s_suppkey as string),
  ', "data": {"road_id": "R', cast(s_suppkey as string), '", "speed_limit": "', cast(s_suppkey % 5 * 20 + 40 as string), '"}}') as value
from supplier
""",
    "job_logs": """
select case when event_id % 2 = 0
  then concat('{"timestamp": "', cast(cast(ts as date) as string), 'T10:00:00", "job": "', case event_id % 3 when 0 then 'flink-count' when 1 then 'hive-load' else 'etl-day' end, '", "level": "info", "message": "row ', cast(event_id as string), ' token=abc"}')
  else concat(cast(cast(ts as date) as string), ' 11:00:00 ERROR kafka-feed: it failed at ', cast(event_id as string)) end as value
from events
""",
}
TABLES = ("region", "nation", "customer", "supplier", "events")
#: Views over another view.
OVER = {"status_text": "traffic_status", "status_json": "traffic_status"}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The role view, or else the table, of that name."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, used = SQL[name].replace("{", "{{").replace("}", "}}"), [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", SQL[name])]
    for t in used:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    if name in OVER:
        sql = re.sub(rf"\b(from|join) {OVER[name]}\b", rf"\1 {{{OVER[name]}}}", sql)
        given[OVER[name]] = role(spark, sf_dir, OVER[name])
    return spark.sql(sql, **given)
