"""The warehouse tables in SQL, as common table expressions, for checks against another engine."""

from __future__ import annotations

from ..functions.columns import FAULT_GRADES, HEALTH_GRADES, RELIABILITY
from ..sources.roles import SQL as ROLES


def r(x: str, places: int = 2) -> str:
    return f"round(cast({x} as double) + 1e-9, {places})"


def mean(x: str) -> str:
    return f"cast(sum({x}) as double) / nullif(count({x}), 0)"


def pct(a: str, b: str) -> str:
    return f"cast({a} as double) * 100.0e0 / nullif(cast({b} as double), 0.0e0)"


def cnt(cond: str) -> str:
    return f"cast(sum(case when {cond} then 1 else 0 end) as bigint)"


def big(x: str) -> str:
    return f"cast({x} as bigint)"


def grade(x: str, steps: list, default: str) -> str:
    return "case " + " ".join(f"when {x} >= {n} then '{label}'" for n, label in steps) + f" else '{default}' end"


def period(h: str) -> str:
    return f"case when {h} between 7 and 9 then 'MORNING_PEAK' when {h} between 17 and 19 then 'EVENING_PEAK' when {h} between 6 and 22 then 'DAY_NORMAL' else 'NIGHT_NORMAL' end"


def first(keys: str, order: str) -> str:
    return f"row_number() over (partition by {keys} order by {', '.join(x + ' nulls first' for x in order.split())})"


_ALARM = "'OFFLINE', 'CPU_HIGH', 'MEMORY_HIGH', 'TEMP_HIGH', 'SIGNAL_WEAK', 'HARDWARE_FAULT'"
_TYPE = f"case when alarm_type in ({_ALARM}) then alarm_type else 'OTHER' end"
_LEVEL = "case when alarm_level in ('CRITICAL', 'MAJOR', 'MINOR', 'WARNING') then alarm_level else 'WARNING' end"
_SAMPLES = "(abnormal_count + warning_count + normal_count)"
_ONLINE = pct("online_duration", "online_duration + offline_count")


def _alarm_day(keys: str) -> str:
    return f"""select {keys}, alarm_type, alarm_level, dt, count(*) as total_alarm_count, {cnt("is_recovered = 'Y'")} as recovered_count,
  {cnt("is_recovered = 'N'")} as unrecovered_count, {r(pct(cnt("is_recovered = 'Y'"), "count(*)"))} as recovery_rate, {r(mean("recover_duration_min"))} as avg_recover_minutes,
  max(recover_duration_min) as max_recover_minutes, min(recover_duration_min) as min_recover_minutes, count(distinct device_id) as affected_device_count,
  {", ".join(f"{cnt(f'''alarm_level = '{x}' ''')} as {x.lower()}_count" for x in ("CRITICAL", "MAJOR", "MINOR", "WARNING"))}
  from dwd_alarm_log group by {keys}, alarm_type, alarm_level, dt"""


WAREHOUSE: dict[str, str] = {
    "dwd_vehicle_pass": f"""select vehicle_id, road_id, device_id, try_cast(pass_time as timestamp) as pass_time, speed, coalesce(direction,
      'UNKNOWN') as direction,
  case when vehicle_type in ('SMALL', 'MEDIUM', 'LARGE') then vehicle_type else 'OTHER' end as vehicle_type, lane,
    cast(hour(try_cast(pass_time as timestamp)) as int) as hour,
  {r("speed / 3600.0e0", 4)} as speed_km_per_s, dt
  from (select *, {first("vehicle_id, pass_time", "road_id device_id speed direction vehicle_type lane dt")} as rn from (select * replace (try_cast(speed as int) as speed) from vehicle_pass)
    where vehicle_id is not null and road_id is not null and speed between 0 and 200) where rn = 1""",
    "dwd_traffic_status": f"""select road_id, avg_speed, traffic_flow, jam_level, congestion_rate, case when peak_flag in ('PEAK_HOUR', 'NORMAL',
      'OFF_PEAK') then peak_flag else 'NORMAL' end as peak_flag, sample_time,
  case jam_level when 1 then 'FREE' when 2 then 'FAIR' when 3 then 'LIGHT' when 4 then 'MEDIUM' when 5 then 'SEVERE' else 'UNKNOWN' end as jam_desc, dt
  from (select *, {first("road_id, sample_time", "avg_speed traffic_flow jam_level congestion_rate peak_flag dt")} as rn from traffic_status
    where road_id is not null and jam_level between 1 and 5 and congestion_rate between 0 and 100 and traffic_flow between 0 and 5000) where rn = 1""",
    "dwd_device_status": f"""select device_id, cpu_usage, memory_usage, temperature, case when online_flag in ('ONLINE', 'OFFLINE', 'UNKNOWN')
      then online_flag else 'UNKNOWN' end as online_flag, heartbeat_time, signal_strength, 'SENSOR' as device_type,
  case when cpu_usage > 90 or memory_usage > 90 or temperature > 70 or online_flag = 'OFFLINE' or signal_strength < -90 then 'ABNORMAL'
    when cpu_usage > 70 or memory_usage > 70 or temperature > 50 then 'WARNING' else 'NORMAL' end as health_flag, dt
  from (select *, {first("device_id, heartbeat_time", "cpu_usage memory_usage temperature online_flag signal_strength dt")} as rn from device_status
    where device_id is not null and cpu_usage between 0 and 100 and memory_usage between 0 and 100 and temperature between -40 and 100) where rn = 1""",
    "dwd_alarm_log": f"""select concat(device_id, '_', type0, '_', cast(bucket as string)) as alarm_id, device_id, alarm_type, alarm_level,
      max(coalesce(alarm_content, '')) as alarm_content, min(alarm_time) as alarm_time, max(recover_time) as recover_time,
  max(status) as recover_status, cast(floor((epoch(max(recover_time)) - epoch(min(alarm_time))) / 60) as bigint) as recover_duration_min, case
    when max(recover_time) is not null then 'Y' else 'N' end as is_recovered, dt
  from (select device_id, alarm_type as type0, {_TYPE} as alarm_type, {_LEVEL} as alarm_level, alarm_content, alarm_time, recover_time,
    cast(floor(epoch(alarm_time) / 300) as bigint) as bucket, dt,
      case when recover_status in ('RECOVERED', 'UNRECOVERED') then recover_status when recover_time is not null then 'RECOVERED'
        else 'UNRECOVERED' end as status
    from alarm_log where alarm_id is not null and device_id is not null) group by device_id, type0, bucket, alarm_type, alarm_level, dt""",
    "dws_road_hour_flow": f"""select road_id, hour, dt, count(*) as traffic_count, {big("sum(speed)")} as total_speed, {r(mean("speed"))} as avg_speed,
  {", ".join(f"{cnt(f'''vehicle_type = '{x}' ''')} as {x.lower()}_car_cnt" for x in ("SMALL", "MEDIUM", "LARGE", "OTHER"))} from dwd_vehicle_pass group by road_id, hour, dt""",
    "dws_area_jam_hour": f"""select area_id, hour, peak_period, jam_level, dt, count(distinct road_id) as affected_road_count,
      {", ".join(f"{cnt(f'jam_level = {n}')} as jam_level{n}_cnt" for n in range(1, 6))},
  {r(mean("congestion_rate"))} as avg_congestion_rate, {big("sum(traffic_flow)")} as total_traffic_flow
  from (select s.*, area_id, cast(hour(sample_time) as int) as hour,
    {period("hour(sample_time)")} as peak_period from dwd_traffic_status s join road using (road_id) join (select area_id from area) using (area_id)) group by area_id, hour, peak_period, jam_level, dt""",
    "dws_device_health_day": f"""select device_id, dt, {cnt("online_flag = 'ONLINE'")} as online_duration,
      {cnt("online_flag = 'OFFLINE'")} as offline_count, {r(mean("cpu_usage"))} as avg_cpu_usage, cast(max(cpu_usage) as double) as max_cpu_usage,
  {r(mean("memory_usage"))} as avg_memory_usage, cast(max(memory_usage) as double) as max_memory_usage,
    {r(mean("temperature"), 1)} as avg_temperature, cast(max(temperature) as double) as max_temperature,
  {", ".join(f"{cnt(f'''health_flag = '{x}' ''')} as {x.lower()}_count" for x in ("ABNORMAL", "WARNING", "NORMAL"))}, max(strftime(heartbeat_time,
    '%Y-%m-%d %H:%M:%S')) as last_heartbeat, min(signal_strength) as min_signal, {r(mean("signal_strength"))} as avg_signal
  from dwd_device_status group by device_id, dt""",
    "dws_alarm_day": _alarm_day("1 as one").replace("select 1 as one, ", "select ").replace("group by 1 as one, ", "group by "),
    "dws_alarm_device_day": _alarm_day("device_id").replace(" count(distinct device_id) as affected_device_count,", ""),
    "op_flow": f"""select area_id, hour, dt, {big("sum(traffic_count)")} as total_vehicle_flow,
      {r("cast(sum(total_speed) as double) / sum(traffic_count)")} as avg_speed_all, max(traffic_count) as peak_flow,
        count(distinct road_id) as total_road_count
  from dws_road_hour_flow join road using (road_id) group by area_id, hour, dt""",
    "op_jam": f"""select area_id, hour, dt, {big("sum(case when jam_level >= 3 then affected_road_count else 0 end)")} as jam_road_count,
      {big("sum(case when jam_level = 5 then affected_road_count else 0 end)")} as severe_jam_count,
  {r("avg(avg_congestion_rate)")} as avg_congestion_rate, max(avg_congestion_rate) as most from dws_area_jam_hour group by area_id, hour, dt""",
    "ads_traffic_operation": f"""select city_id, city_name, area_id, area_name, hour, {period("hour")} as peak_period, total_vehicle_flow,
      avg_speed_all, peak_flow, peak_hour, coalesce(jam_road_count, 0) as jam_road_count,
  {r(pct("coalesce(jam_road_count, 0)", "total_road_count"))} as jam_road_ratio, coalesce(severe_jam_count, 0) as severe_jam_count,
    avg_congestion_rate, total_road_count, coalesce(peak_hour_duration, 0) as peak_hour_duration,
  {r(pct("total_vehicle_flow", "total_road_count * 3000"))} as area_saturation, dt
  from op_flow left join op_jam using (area_id, hour, dt) join (select area_id, dt, hour as peak_hour from (select *,
    row_number() over (partition by area_id, dt order by total_vehicle_flow desc, hour) as k from op_flow) where k = 1) using (area_id, dt)
  left join (select area_id, dt, count(distinct hour) as peak_hour_duration from op_jam where most > 50 group by area_id, dt) using (area_id,
    dt) join area using (area_id)""",
    "ads_top_jam_roads": f"""select * from (select row_number() over (partition by dt order by avg_jam_level desc, avg_congestion_rate desc,
      road_id) as rank_num, road_id, road_name, road_type, area_id, area_name, peak_period, avg_jam_level, max_jam_level, avg_congestion_rate,
        total_traffic_flow, peak_time, dt
  from (select area_id, dt, {r("avg(jam_level)")} as avg_jam_level, max(jam_level) as max_jam_level,
    {r("avg(avg_congestion_rate)")} as avg_congestion_rate, {big("sum(total_traffic_flow)")} as total_traffic_flow from dws_area_jam_hour group by area_id, dt)
  join (select area_id, dt, hour as peak_time, peak_period from (select *, row_number() over (partition by area_id,
    dt order by avg_congestion_rate desc, hour) as k from dws_area_jam_hour) where k = 1) using (area_id, dt)
  join area using (area_id) join road using (area_id)) where rank_num <= 20""",
    "ads_top_jam_roads_by_road": f"""select rank_num, road_id, avg_jam_level, max_jam_level, avg_congestion_rate, total_traffic_flow, dt, road_name,
      area_id from (select *, row_number() over (partition by dt order by avg_jam_level desc, avg_congestion_rate desc, road_id) as rank_num
  from (select road_id, dt, {r(mean("jam_level"))} as avg_jam_level, max(jam_level) as max_jam_level,
    {r(mean("congestion_rate"))} as avg_congestion_rate, {big("sum(traffic_flow)")} as total_traffic_flow from dwd_traffic_status group by road_id,
      dt)) join road using (road_id) where rank_num <= 20""",
    "health_parts": f"""select h.*, device_name, device_type, road_id, area_id, coalesce(total_alarm_count, 0) as total_alarm_count,
      coalesce(recovery_rate, 100.0e0) as recovery_rate, {_ONLINE} as online, {_ONLINE} / 100.0e0 * 40.0e0 as p1,
  greatest(0.0e0, 1.0e0 - (avg_cpu_usage + avg_memory_usage) / 200.0e0) * 30.0e0 as p2, greatest(0.0e0,
    1.0e0 - cast(abnormal_count as double) / nullif(cast({_SAMPLES} as double), 0.0e0)) * 30.0e0 as p3
  from dws_device_health_day h join device using (device_id) join (select road_id, area_id from road) using (road_id)
  left join (select device_id, dt, {big("sum(total_alarm_count)")} as total_alarm_count,
    {r("avg(recovery_rate)")} as recovery_rate from dws_alarm_device_day where alarm_type in ({_ALARM}) group by device_id, dt) using (device_id,
      dt)""",
    "ads_device_health_score": f"""select device_id, device_name, device_type, road_id, area_id, {r("online")} as online_rate, avg_cpu_usage,
      avg_memory_usage, avg_temperature, {r(pct("abnormal_count", _SAMPLES))} as abnormal_rate, total_alarm_count, recovery_rate,
  {r("p1")} as online_score, {r("p2")} as resource_score, {r("p3")} as fault_score, {r("p1 + p2 + p3")} as health_score,
    {grade(r("p1 + p2 + p3"), HEALTH_GRADES, "CRITICAL")} as health_level, dt from health_parts""",
    "mtbf_parts": f"""select d.*, dt, coalesce(n, 0) as n, coalesce(back, 0) as back, coalesce(mttr, 0.0e0) as mttr, case when coalesce(n, 0) = 0
      then 1440.0e0 else 1440.0e0 / n end as mtbf from device d cross join (select distinct dt from alarm_log)
  left join (select device_id, dt, {big("sum(total_alarm_count)")} as n, {big("sum(recovered_count)")} as back,
    {r("avg(avg_recover_minutes)")} as mttr from dws_alarm_device_day group by device_id, dt) using (device_id, dt)""",
    "ads_device_mtbf_mttr": f"""select device_id, device_name, device_type, manufacturer, road_id, n as total_alarm_count, back as recovered_count,
      1440 as total_runtime_minutes, {r("mtbf")} as mtbf_minutes, mttr as mttr_minutes, {r("mtbf / 60.0e0")} as mtbf_hours,
  {grade("mtbf", RELIABILITY, "LOW")} as reliability_rank, dt from mtbf_parts""",
    "ads_device_fault_top": f"""select * from (select row_number() over (partition by dt order by fault_rate desc, abnormal_count desc,
      device_id) as rank_num, device_id, device_name, device_type, manufacturer, road_id, area_id, area_name, fault_rate, abnormal_count,
        warning_count, offline_count,
  {r(_ONLINE)} as online_rate, avg_cpu_usage, avg_memory_usage, avg_temperature, health_level, dt
  from (select *, {r(pct("abnormal_count", _SAMPLES))} as fault_rate,
    {grade(pct("abnormal_count", _SAMPLES), FAULT_GRADES, "NORMAL")} as health_level from dws_device_health_day)
  join device using (device_id) join (select road_id, area_id from road) using (road_id) join (select area_id,
    area_name from area) using (area_id)) where rank_num <= 20""",
}


def sql(query: str, **more: str) -> str:
    """The query with those tables that it needs in front."""
    import re

    known = {**ROLES, **WAREHOUSE, **more}
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(known[name])

    visit(query)
    if not need:
        return query
    return "with recursive " + ",\n".join(f"{n} as ({known[n]})" for n in known if n in need) + "\n" + query
