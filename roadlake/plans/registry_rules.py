"""Registers the device rules, their alerts and the summaries at the rules' own numbers, over dense views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alerts, clean, quality, series
from ..operators.anomaly import summary
from ..sources.shared import shared_dir
from ..streaming import jobs, rules, stateful
from . import analytics
from .oracle import WAREHOUSE, big, mean, pct, r
from .registry import add
from .registry_operators import _ALL, _checks
from .warehouse import dwd_device_status, dwd_traffic_status

_PULSE = WAREHOUSE["dwd_device_status"].replace("from device_status", "from device_pulse")
_RUNS = """
select device_id, {name} as rule, first_ts, last_ts from (
  select device_id, heartbeat_time as last_ts, lag(heartbeat_time, {m}) over w as first_ts,
    sum(case when {cond} then 1 else 0 end) over (w rows between {m} preceding and current row) as run
  from pulse window w as (partition by device_id order by heartbeat_time))
where run = {n} and epoch(last_ts) - epoch(first_ts) < {within}
"""


def _runs(name: str, cond: str, n: int, within: int) -> str:
    return _RUNS.format(name=repr(name), cond=cond, n=n, m=n - 1, within=within)


_MATCHES = " union all ".join(_runs(name, cond, n, within) for name, _, cond, n, within, _ in rules.RULES)
_LEVELS = " ".join(f"when '{k}' then '{level}'" for k, level, *_ in rules.RULES)
_REASONS = " ".join(f"when '{row[0]}' then '{row[5]}'" for row in rules.RULES)


def _pulse(t) -> DataFrame:
    return dwd_device_status(t["device_pulse"])


for _id, _rule in zip(("r8", "r9", "r10", "r11"), rules.RULES):

    @add(f"{_id}_{_rule[0].lower()}_rule", f"select * from ({_runs(_rule[0], *_rule[2:5])})", pulse=_PULSE)
    def _(t, _rule=_rule):
        return rules.matches(_pulse(t), rules=[_rule])


@add("r13_rule_alerts", f"""
select case rule {_LEVELS} end as alert_level, rule as alert_type, device_id, first_ts, last_ts,
  'Device ' || device_id || ' ' || case rule {_REASONS} end || ' detected at ' || epoch_ms(last_ts) as message
from matches
""", pulse=_PULSE, matches=_MATCHES)
def _(t):
    return rules.alert_rows(rules.matches(_pulse(t)))


@add("s17_alert_text", f"""
select 'ALERT|' || case rule {_LEVELS} end || '|' || rule || '|Device ' || device_id || ' ' || case rule {_REASONS} end
  || ' detected at ' || epoch_ms(last_ts) as value
from matches
""", pulse=_PULSE, matches=_MATCHES)
def _(t):
    return rules.alert_text(rules.alert_rows(rules.matches(_pulse(t))))


def _streamed(df: DataFrame, ts: str, key: str, job) -> DataFrame:
    """What a stream job gives for the rows of df, of which two late rows of another key close the last windows.

    Each of the three parts is a run of its own, which goes on from the checkpoint of the one before.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for closing in (False, True, True):
        if closing:
            # One row beyond the end of what has been written, which is read back: df itself is computed once.
            end = spark.read.schema(df.schema).parquet(f"{path}/in").agg(F.max(ts).alias(ts))
            rows = end.select(*[(F.col(ts) + F.expr("interval 30 days")).alias(ts) if c == ts else F.lit("closing" if c == key else None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        else:
            rows = df
        rows.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
        jobs.run_available(job(stream), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").filter(F.col(key) != "closing")


@add("r1_stream_counts", f"""
select time_bucket(interval 5 minute, pass_time) as window_start, road_id, count(*) as n, {big('sum(speed)')} as total_speed, {r(mean('speed'))} as avg_speed
from dwd_vehicle_pass group by 1, 2
""")
def _(t):
    return _streamed(t["dwd_vehicle_pass"].select("road_id", "speed", "pass_time"), "pass_time", "road_id", jobs.road_counts)


@add("r12_rule_stream", "select * from matches", pulse=_PULSE, matches=_MATCHES)
def _(t):
    return _streamed(_pulse(t), "heartbeat_time", "device_id", rules.matches)


_SENT = """
select device_id, alarm_time as sent_at, i, alarm_time from numbered where i = 1 union all
select n.device_id, case when epoch(n.alarm_time) - epoch(s.sent_at) >= 1800 then n.alarm_time else s.sent_at end, n.i, n.alarm_time
from sent s join numbered n on n.device_id = s.device_id and n.i = s.i + 1
"""
_NUMBERED = """
select device_id, alarm_time, row_number() over (partition by device_id order by alarm_time) as i
from (select distinct device_id, alarm_time from alarm_pulse)
"""


@add("l1_suppress_30_min", "select device_id, alarm_time from sent where sent_at = alarm_time", numbered=_NUMBERED, sent=_SENT)
def _(t):
    out = alerts.suppress(t["alarm_pulse"], "device_id", "alarm_time", 30)
    return out.filter("sent").select("device_id", "alarm_time")


@add("l1_suppress_stream", "select device_id, alarm_time from sent where sent_at = alarm_time", numbered=_NUMBERED, sent=_SENT)
def _(t):
    rows = t["alarm_pulse"].select("device_id", "alarm_time").distinct()
    return _streamed(rows, "alarm_time", "device_id", lambda s: stateful.suppress_stream(s, ["device_id"], "alarm_time", 30))


@add("r15_frequent_alarms", """
select device_id, time_bucket(interval 5 minute, alarm_time) as window_start, count(*) as n, 'CRITICAL' as level from alarm_pulse group by 1, 2 having count(*) > 10
union all select device_id, time_bucket(interval 1 day, alarm_time), count(*), 'WARNING' from alarm_pulse group by 1, 2 having count(*) >= 5
""")
def _(t):
    return series.frequent(t["alarm_pulse"], "device_id", "alarm_time")


@add("l1_alert_key", """
select alarm_id, md5('{"alarm_level":"' || alarm_level || '","alarm_type":"' || alarm_type || '","device_id":"' || device_id || '"}') as alert_key from alarm_pulse
""")
def _(t):
    return t["alarm_pulse"].select("alarm_id", alerts.alert_key(["device_id", "alarm_type", "alarm_level"]).alias("alert_key"))


@add("l5_latest_alerts", """
select dt, recency, alarm_id from (select *, row_number() over (partition by dt order by alarm_time desc, alarm_id) as recency from alarm_pulse) where recency <= 20
""")
def _(t):
    return alerts.latest(t["alarm_pulse"], "alarm_time", "alarm_id").select("dt", "recency", "alarm_id")


@add("n7_single_road_jam", """
select road_id, start_ts, end_ts, n, minutes, case when minutes > 60 then 'CRITICAL' else 'WARNING' end as level
from (select road_id, min(sample_time) as start_ts, max(sample_time) as end_ts, count(*) as n, (epoch(max(sample_time)) - epoch(min(sample_time))) / 60.0e0 as minutes
  from (select *, sum(case when jam_level = 5 then 0 else 1 end) over (partition by road_id order by sample_time) as part from dwd_traffic_status)
  where jam_level = 5 group by road_id, part)
where minutes > 30
""")
def _(t):
    return series.sustained(t["dwd_traffic_status"], "road_id", "sample_time", F.col("jam_level") == 5)


@add("n7_dense_jam", """
select road_id, start_ts, end_ts, n, minutes, case when minutes > 60 then 'CRITICAL' else 'WARNING' end as level
from (select road_id, min(sample_time) as start_ts, max(sample_time) as end_ts, count(*) as n, (epoch(max(sample_time)) - epoch(min(sample_time))) / 60.0e0 as minutes
  from (select *, sum(case when jam_level = 5 then 0 else 1 end) over (partition by road_id order by sample_time) as part from status_pulse)
  where jam_level = 5 group by road_id, part)
where minutes > 30
""")
def _(t):
    return series.sustained(t["status_pulse"], "road_id", "sample_time", F.col("jam_level") == 5)


_PAUSES = "select (epoch(heartbeat_time) - epoch(lag(heartbeat_time) over (partition by device_id order by heartbeat_time))) / 60 > 60 as bad from device_status"


@add("n5_gap_summary", """
select count(*) as total, cast(sum(case when bad then 1 else 0 end) as bigint) as anomalies,
  case when sum(case when bad then 1 else 0 end) = 0 then 'NORMAL' when sum(case when bad then 1 else 0 end) < 5 then 'WARNING' else 'CRITICAL' end as level
from (select bad from pauses where bad is not null)
""", pauses=_PAUSES)
def _(t):
    found = series.gaps(t["device_status"], "device_id", "heartbeat_time", -1.0)
    return summary(found.withColumn("is_anomaly", F.col("gap_minutes") > 60))


@add("k8_warned", """
select check_type, table_name, dt, metric, case when status = 'PASS' and rate < case check_type when 'uniqueness' then 99.99e0 else 99.5e0 end and check_type <> 'backlog' then 'WARN' else status end as status
from checks
""", checks=_ALL)
def _(t):
    return quality.warned(_checks(t)).select("check_type", "table_name", "dt", "metric", "status")


_RATE = "round(cast(sum(case when check_type = '{k}' then cast(rate as decimal(10,2)) end) as double) / count(case when check_type = '{k}' then rate end) + 1e-9, 2) as {k}_rate"


@add("s16_quality_status", f"""
select {", ".join(_RATE.format(k=k) for k in ("completeness", "uniqueness", "validity"))},
  {big("sum(case when check_type = 'backlog' then value end)")} as backlog, max(dt) as last_check
from checks
""", checks=_ALL)
def _(t):
    return jobs.quality_status(_checks(t))


@add("alarm_type_sets", """
select device_id, string_agg(distinct alarm_type, ',' order by alarm_type) as alarm_types, count(distinct alarm_type) as n from dwd_alarm_log group by device_id
""")
def _(t):
    return clean.sets(t["dwd_alarm_log"], ["device_id"], "alarm_type")


@add("device_sample", "select device_id, heartbeat_time from device_status where cast('0x' || substr(md5(device_id), 1, 6) as bigint) % 100 < 10")
def _(t):
    return clean.sampled(t["device_status"], "device_id", 10).select("device_id", "heartbeat_time")


@add("f4_typed_status", WAREHOUSE["dwd_traffic_status"].replace("congestion_rate, case", "cast(congestion_rate as double) as congestion_rate, case",
    1))
def _(t):
    """The detail table from text columns only."""
    rows = t["traffic_status"]
    return dwd_traffic_status(rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]))


# One day, one area, one type: the parameters of the analytic queries.
_SPEED = r("cast(sum(total_speed) as double) / sum(traffic_count)")


@add("q1_flow_of_one_day", f"""
select dt, {big('sum(traffic_count)')} as total_flow, {_SPEED} as avg_speed from dws_road_hour_flow where dt = '2024-01-05' group by dt
""")
def _(t):
    return analytics.flow_of_day(t, "2024-01-05")


@add("q9_online_trend_of_a_week", f"""
select dt, {r(pct("sum(online_duration)", "sum(online_duration) + sum(offline_count)"))} as online_rate
from dws_device_health_day where dt between '2024-01-04' and '2024-01-10' group by dt
""")
def _(t):
    return analytics.online_trend(t, "2024-01-10")


@add("q21_peaks_of_one_area", f"""
select area_id, hour, peak_period, {r("cast(sum(cast(avg_congestion_rate as decimal(10,2))) as double) / count(avg_congestion_rate)")} as avg_congestion,
  {r("avg(jam_level)")} as avg_jam_level, {big("sum(total_traffic_flow)")} as total_flow, area_name
from dws_area_jam_hour join (select area_id, area_name from area where area_name = 'NATION_3') using (area_id)
where peak_period in ('MORNING_PEAK', 'EVENING_PEAK') group by area_id, hour, peak_period, area_name
""")
def _(t):
    return analytics.peak_analysis(t, "NATION_3")


@add("q12_least_reliable_of_one_day", """
select dt, rank_num, device_id, mtbf_minutes, mttr_minutes, reliability_rank
from (select *, row_number() over (order by mtbf_minutes, device_id) as rank_num from ads_device_mtbf_mttr where dt = '2024-01-05') where rank_num <= 5
""")
def _(t):
    return analytics.least_reliable(t, "2024-01-05", 5)
