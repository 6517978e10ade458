"""Registers the analytic queries with their SQL."""

from __future__ import annotations

from . import analytics as q
from .oracle import big, cnt, mean, pct, period, r
from .registry import add

_SPEED = r("cast(sum(total_speed) as double) / sum(traffic_count)")
_DAY_FLOW = f"select dt, road_id, {big('sum(traffic_count)')} as flow from dws_road_hour_flow group by dt, road_id"


def _top(order: str, cols: str, table: str, n: int) -> str:
    return f"select {cols} from (select *, row_number() over (partition by dt order by {order}) as rank_num from {table}) where rank_num <= {n}"


add("q1_flow_of_day", f"select dt, {big('sum(traffic_count)')} as total_flow, {_SPEED} as avg_speed from dws_road_hour_flow group by dt")(q.flow_of_day)

add("q2_flow_by_hour", f"""
select dt, hour, {big('sum(traffic_count)')} as total_flow, {_SPEED} as avg_speed
from dws_road_hour_flow group by dt, hour
""")(q.flow_by_hour)


add("q3_jam_heat_map", f"""
select area_id, dt, hour, {r('avg(avg_congestion_rate)')} as congestion, max(jam_level) as max_level, any_value(area_name) as area_name
from dws_area_jam_hour join area using (area_id)
group by area_id, dt, hour
""")(q.jam_heat_map)

add("q4_top_jam", "select * from ads_top_jam_roads where rank_num <= 10")(q.top_jam)

add("q5_vehicle_types", f"""
select dt, vehicle_type, vehicles
from (select dt, {', '.join(f'{big(f"sum({k}_car_cnt)")} as {k}' for k in ('small', 'medium', 'large', 'other'))}
  from dws_road_hour_flow group by dt) unpivot (vehicles for vehicle_type in (small, medium, large, other))
""")(q.vehicle_types)


add("q6_per_area", f"""
select dt, area_id, area_name, {big('sum(total_vehicle_flow)')} as flow, {r('avg(avg_congestion_rate)')} as congestion,
  {big('sum(jam_road_count)')} as jams
from ads_traffic_operation group by dt, area_id, area_name
""")(q.per_area)

_H = "select dt, {h} as h, {big_flow} as flow, " + _SPEED + " as avg_speed from dws_road_hour_flow {w} group by dt"
_J = "select dt, {h} as h, " + ", ".join(f"{big(f'sum(case when jam_level = {k} then affected_road_count else 0 end)')} as level{k}" for k in range(1, 6)) + " from dws_area_jam_hour {w} group by dt"
_fill = dict(big_flow=big("sum(traffic_count)"))


@add("q7_hour_snapshot", f"""
select dt, nullif(h, -1) as hour, flow, avg_speed, {", ".join(f"coalesce(level{k}, 0) as level{k}" for k in range(1, 6))}
from
 (select *, row_number() over (partition by dt order by h desc) as k
  from ({_H.format(h=8, w="where hour = 8", **_fill)} union all {_H.format(h=-1, w="", **_fill)}))
left join
 ({_J.format(h=8, w="where hour = 8")} union all {_J.format(h=-1, w="")}) using (dt, h)
where k = 1
""")
def _(t):
    return q.hour_snapshot(t, 8)


add("q8_device_counts", f"""
select dt, count(*) as devices, {cnt('offline_count = 0')} as online, {cnt('offline_count > 0')} as offline, {cnt('health_score < 60')} as faulty
from dws_device_health_day left join (select device_id, dt, health_score
  from ads_device_health_score) using (device_id, dt)
group by dt
""")(q.device_counts)


add("q9_online_trend", f"""
select dt, {r(pct('sum(online_duration)', 'sum(online_duration) + sum(offline_count)'))} as online_rate
from dws_device_health_day group by dt
""")(q.online_trend)


add("q10_health_levels", """
select dt, health_level, coalesce(n, 0) as n
from (select distinct dt from ads_device_health_score)
cross join (values ('EXCELLENT'), ('GOOD'), ('FAIR'), ('POOR'), ('CRITICAL')) v(health_level)
left join (select dt, health_level, count(*) as n
  from ads_device_health_score group by all) using (dt, health_level)
""")(q.health_levels)


add("q11_worst_health", _top("health_score, device_id",
    "dt, rank_num, device_id, device_name, device_type, health_score, online_rate, health_level", "ads_device_health_score",
        20).replace("order by health_score", "order by health_score nulls first"))(q.worst_health)


add("q12_least_reliable", _top("mtbf_minutes, device_id", "dt, rank_num, device_id, mtbf_minutes, mttr_minutes, reliability_rank",
    "ads_device_mtbf_mttr", 20))(q.least_reliable)

add("q13_score_trend", f"select dt, count(*) as devices, {r('avg(health_score)')} as avg_score from ads_device_health_score group by dt")(q.score_trend)

add("q15_jam_ranking", f"""
select road_id, road_name, road_type, area_name, {r('avg(jam_level)', 4)} as avg_jam_level, {r('avg(avg_congestion_rate)', 4)} as avg_congestion_rate,
  {big('sum(total_traffic_flow)')} as total_traffic_flow
from dws_area_jam_hour join road using (area_id)
join area using (area_id) group by road_id, road_name, road_type, area_name
order by avg_congestion_rate desc, road_id limit 10
""")(q.jam_ranking)


add("q16_flow_ranking", f"""
select road_id, road_name, road_type, {big('sum(traffic_count)')} as total_flow, {_SPEED} as avg_speed, max(traffic_count) as peak_flow,
  count(distinct hour) as active_hours
from dws_road_hour_flow join road using (road_id)
group by road_id, road_name, road_type
order by total_flow desc, road_id limit 10
""")(q.flow_ranking)


@add("q17_camera_health", _top("health_score, device_id",
    "dt, rank_num, device_id, device_name, device_type, health_score, online_rate, health_level",
        "(select * from ads_device_health_score where device_type = 'CAMERA')", 5).replace("order by health_score",
            "order by health_score nulls first"))
def _(t):
    return q.worst_health(t, n=5, device_type="CAMERA")


add("q18_fault_statistics", f"""
select device_id, device_name, device_type, alarm_type, alarm_level, {big('sum(total_alarm_count)')} as alarm_count,
  {big('sum(recovered_count)')} as recovered, {r('avg(avg_recover_minutes)', 1)} as avg_recover_minutes,
    {r(pct('sum(recovered_count)', 'sum(total_alarm_count)'), 1)} as recovery_rate
from dws_alarm_device_day join device using (device_id)
group by device_id, device_name, device_type, alarm_type, alarm_level
order by alarm_count desc, device_id, alarm_type, alarm_level limit 10
""")(q.fault_statistics)


add("q19_area_congestion", f"""
select area_id, area_name, city_name, {r('avg(avg_congestion_rate)')} as avg_congestion, max(avg_congestion_rate) as max_congestion,
  {cnt('jam_level >= 4')} as severe_jam_count, {big('sum(total_traffic_flow)')} as total_flow
from dws_area_jam_hour join area using (area_id)
group by area_id, area_name, city_name
""")(q.area_congestion)


add("q20_offline_devices", """
select dt, device_id, offline_count, last_heartbeat, device_name, device_type, road_id, manufacturer
from dws_device_health_day join device using (device_id)
where offline_count > 0
""")(q.offline_devices)


add("q21_peak_analysis", f"""
select area_id, area_name, hour, peak_period, {r('avg(avg_congestion_rate)')} as avg_congestion, {r('avg(jam_level)')} as avg_jam_level,
  {big('sum(total_traffic_flow)')} as total_flow
from dws_area_jam_hour join area using (area_id)
where peak_period in ('MORNING_PEAK', 'EVENING_PEAK')
group by area_id, area_name, hour, peak_period
""")(q.peak_analysis)


@add("q22_quality_of_table", f"""
select count(*) as total, {cnt('vehicle_id is null or road_id is null')} as null_rows,
  {r('100.0e0 - (' + pct(cnt('vehicle_id is null or road_id is null'), 'count(*)') + ')')} as completeness, count(distinct case
    when vehicle_id is not null and pass_time is not null then (vehicle_id, pass_time) end) as unique_keys,
      {r(pct('count(distinct case when vehicle_id is not null and pass_time is not null then (vehicle_id, pass_time) end)', 'count(*)'))} as uniqueness
from vehicle_pass
""")
def _(t):
    return q.quality_of_table(t["vehicle_pass"], ["vehicle_id", "road_id"], ["vehicle_id", "pass_time"])


@add("q23_road_trend", f"""
select dt, cast(hour(sample_time) as int) as hour, {r(mean('jam_level'))} as avg_jam_level, {r(mean('congestion_rate'))} as avg_congestion_rate
from dwd_traffic_status where road_id = 'R7'
group by dt, hour(sample_time)
""")
def _(t):
    return q.road_trend(t, "R7")


add("q24_above_mean", f"""
select dt, road_id, flow from (select *, avg(flow) over (partition by dt) as m
  from ({_DAY_FLOW})) where flow > m * 1.5e0
""")(q.above_mean)


add("q25_online_rate", f"""
select device_id, count(*) as samples, {r(pct(cnt('''online_flag = 'ONLINE' '''), 'count(*)'))} as online_rate
from dwd_device_status group by device_id
""")(q.online_rate)


@add("q26_health_named", _top("health_score desc, device_id",
    "dt, rank_num, device_id, device_name, device_type, health_score, online_rate, health_level", "ads_device_health_score",
        10).replace("health_score desc", "health_score desc nulls last"))
def _(t):
    return q.worst_health(t, n=10, order="desc")


add("q27_road_detail", f"""
select road_id, avg_jam_level, coalesce(flow, 0) as flow, avg_speed
from (select road_id, {r(mean('jam_level'))} as avg_jam_level
  from dwd_traffic_status group by road_id)
left join (select road_id, count(*) as flow, {r(mean('speed'))} as avg_speed
  from dwd_vehicle_pass group by road_id) using (road_id)
""")(q.road_detail)


add("q27b_busiest_hours", """
select dt, hour, flow, rank_num
from (select *, row_number() over (partition by dt order by flow desc, hour) as rank_num
  from (select dt, hour, count(*) as flow
    from dwd_vehicle_pass group by dt, hour))
where rank_num <= 3
""")(q.busiest_hours)


@add("q28_flow_in_daytime", f"""
select dt, hour, {big('sum(traffic_count)')} as total_flow, {_SPEED} as avg_speed
from dws_road_hour_flow where hour between 7 and 19
group by dt, hour
""")
def _(t):
    return q.flow_by_hour(t, low=7, high=19)


add("q29_passes_per_road", f"""
select road_id, passes, avg_speed, road_name, area_id, area_name
from (select road_id, count(*) as passes, {r(mean('speed'))} as avg_speed
  from dwd_vehicle_pass group by road_id)
join road using (road_id) join area using (area_id)
order by passes desc, road_id limit 10
""")(q.passes_per_road)


add("q30_day_overview", f"""
select * from (select dt, count(*) as rows, {r(mean('speed'))} as avg_speed
  from dwd_vehicle_pass group by dt)
left join (select dt, {r(mean('congestion_rate'))} as congestion
  from dwd_traffic_status group by dt) using (dt)
left join (select dt, count(*) as devices, {r('avg(health_score)')} as avg_score
  from ads_device_health_score group by dt) using (dt)
""")(q.day_overview)


add("q31_compare_days", f"""
select road_id, dt, f.flow, b.flow as flow_before, {r(pct('f.flow - b.flow', 'b.flow'))} as change_pct
from ({_DAY_FLOW}) f left join (select road_id, cast(cast(dt as date) + interval 1 day as date)::varchar as dt, flow
  from ({_DAY_FLOW})) b using (road_id, dt)
""")(q.compare_days)


@add("q31b_compare_areas", f"""
select dt, hour, {big('''sum(case when area_id = 'A1' then total_vehicle_flow end)''')} as flow_one,
  {big('''sum(case when area_id = 'A2' then total_vehicle_flow end)''')} as flow_other
from ads_traffic_operation where area_id in ('A1', 'A2')
group by dt, hour
""")
def _(t):
    return q.compare_areas(t, "A1", "A2")


add("q31c_recent_alarms", """
select alarm_id, device_id, alarm_type, alarm_level, alarm_time
from dwd_alarm_log where epoch((select max(alarm_time)
    from dwd_alarm_log)) - epoch(alarm_time) <= 86400
""")(q.recent_alarms)


add("a14_whole_table", """
select * from (select count(*) as passes, count(distinct road_id) as roads
  from dwd_vehicle_pass) cross join (select count(*) as alarms
  from dwd_alarm_log) cross join (select count(*) as samples, count(distinct device_id) as devices
  from dwd_device_status)
""")(q.whole_table)


add("n8_area_jam", f"""
select *, case when jam_rate >= 60 then 'CRITICAL' when jam_rate >= 40 then 'WARNING' else 'NORMAL' end as level, {period('hour')} as period
from (select area_id, dt, hour, {r(pct('sum(case when jam_level >= 3 then affected_road_count else 0 end)', 'sum(affected_road_count)'))} as jam_rate
  from dws_area_jam_hour group by area_id, dt, hour)
""")(q.area_jam_bands)

