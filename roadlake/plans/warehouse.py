"""The warehouse tables: detail (dwd), summaries (dws) and indicators (ads).

Inputs are DataFrames; every table carries its partition column dt, so the
functions serve one day or any range of days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import (
    ALARM_LEVELS, ALARM_TYPES, DEVICE_TYPES, FAULT_GRADES, HEALTH_GRADES, JAM_LABELS, ONLINE_FLAGS, PEAK_FLAGS, RELIABILITY, VEHICLE_TYPES,
    band, count_where, decode, health_flag, mean, normalize_enum, percent, period, rounded, to_time,
)
from ..operators.clean import aggregate, clean
from ..operators.joins import with_current

Tables = dict[str, DataFrame]
c = F.col


def typed(ods: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns of landing text (or of typed sources) in the types of the table; what does not fit is null, not an error."""
    return ods.withColumns({k: to_time(c(k)) if t == "timestamp" else c(k).try_cast(t) for k, t in types.items()})


def dwd_vehicle_pass(ods: DataFrame) -> DataFrame:
    return clean(
        typed(ods, {"pass_time": "timestamp", "speed": "int", "lane": "int"}), {
            **{k: c(k) for k in ("vehicle_id", "road_id", "device_id", "pass_time", "speed")},
            "direction": F.coalesce("direction", F.lit("UNKNOWN")), "vehicle_type": normalize_enum(c("vehicle_type"), VEHICLE_TYPES, "OTHER"),
            "lane": c("lane"), "hour": F.hour("pass_time"), "speed_km_per_s": rounded(c("speed") / 3600.0, 4).cast("decimal(10,4)"), "dt": c("dt"),
        },
        c("vehicle_id").isNotNull() & c("road_id").isNotNull() & c("speed").between(0, 200),
        ["vehicle_id", "pass_time"], ["road_id", "device_id", "speed", "direction", "vehicle_type", "lane", "dt"])


def dwd_traffic_status(ods: DataFrame) -> DataFrame:
    types = {"avg_speed": "int", "traffic_flow": "int", "jam_level": "int", "congestion_rate": "decimal(5,2)", "sample_time": "timestamp"}
    return clean(
        typed(ods, types), {
            **{k: c(k) for k in ("road_id", "avg_speed", "traffic_flow", "jam_level", "congestion_rate")},
            "peak_flag": normalize_enum(c("peak_flag"), PEAK_FLAGS, "NORMAL"), "sample_time": c("sample_time"),
            "jam_desc": decode(c("jam_level"), JAM_LABELS, "UNKNOWN"), "dt": c("dt"),
        },
        c("road_id").isNotNull() & c("jam_level").between(1, 5) & c("congestion_rate").between(0, 100) & c("traffic_flow").between(0, 5000),
        ["road_id", "sample_time"], ["avg_speed", "traffic_flow", "jam_level", "congestion_rate", "peak_flag", "dt"])


def dwd_device_status(ods: DataFrame) -> DataFrame:
    types = {"cpu_usage": "decimal(5,2)", "memory_usage": "decimal(5,2)", "temperature": "decimal(4,1)", "heartbeat_time": "timestamp",
        "signal_strength": "int"}
    kind = normalize_enum(c("device_type"), DEVICE_TYPES, "SENSOR") if "device_type" in ods.columns else F.lit("SENSOR")
    return clean(
        typed(ods, types), {
            **{k: c(k) for k in ("device_id", "cpu_usage", "memory_usage", "temperature")},
            "online_flag": normalize_enum(c("online_flag"), ONLINE_FLAGS, "UNKNOWN"), "heartbeat_time": c("heartbeat_time"),
            "signal_strength": c("signal_strength"), "device_type": kind,
            "health_flag": health_flag(c("cpu_usage"), c("memory_usage"), c("temperature"), c("online_flag"), c("signal_strength")), "dt": c("dt"),
        },
        c("device_id").isNotNull() & c("cpu_usage").between(0, 100) & c("memory_usage").between(0, 100) & c("temperature").between(-40, 100),
        ["device_id", "heartbeat_time"], ["cpu_usage", "memory_usage", "temperature", "online_flag", "signal_strength", "dt"])


def dwd_alarm_log(ods: DataFrame, seconds: int = 300) -> DataFrame:
    """Repeats of one device, type and bucket are one alarm; an unrecovered one wins within it."""
    known = c("recover_status").isin("RECOVERED", "UNRECOVERED")
    status = F.when(known, c("recover_status")).when(c("recover_time").isNotNull(), "RECOVERED").otherwise("UNRECOVERED")
    bucket = F.floor(F.unix_timestamp("alarm_time") / seconds).cast("long").cast("string")
    rows = typed(ods, {"alarm_time": "timestamp", "recover_time": "timestamp"}).filter("alarm_id is not null and device_id is not null")
    merged = rows.groupBy(
        F.concat("device_id", F.lit("_"), "alarm_type", F.lit("_"), bucket).alias("alarm_id"), "device_id",
        normalize_enum(c("alarm_type"), ALARM_TYPES, "OTHER").alias("alarm_type"),
        normalize_enum(c("alarm_level"), ALARM_LEVELS, "WARNING").alias("alarm_level"), "dt",
    ).agg(
        F.max(F.coalesce("alarm_content", F.lit(""))).alias("alarm_content"), F.min("alarm_time").alias("alarm_time"),
        F.max("recover_time").alias("recover_time"), F.max(status).alias("recover_status"))
    minutes = F.floor((F.unix_timestamp("recover_time") - F.unix_timestamp("alarm_time")) / 60).cast("long")
    return merged.select(
        "alarm_id", "device_id", "alarm_type", "alarm_level", "alarm_content", "alarm_time", "recover_time", "recover_status",
        minutes.alias("recover_duration_min"), F.when(c("recover_time").isNotNull(), "Y").otherwise("N").alias("is_recovered"), "dt")


def dws_road_hour_flow(passes: DataFrame) -> DataFrame:
    return aggregate(passes, ["road_id", "hour", "dt"], {
        "traffic_count": F.count("*"), "total_speed": F.sum("speed").cast("long"), "avg_speed": rounded(mean(c("speed"))),
        **{f"{t.lower()}_car_cnt": count_where(c("vehicle_type") == t) for t in [*VEHICLE_TYPES, "OTHER"]}})


def dws_area_jam_hour(status: DataFrame, road: DataFrame, area: DataFrame) -> DataFrame:
    rows = with_current(with_current(status, road.select("road_id", "area_id"), "road_id"), area.select("area_id"), "area_id")
    hour = F.hour("sample_time")
    return rows.groupBy("area_id", hour.alias("hour"), period(hour).alias("peak_period"), "jam_level", "dt").agg(
        F.countDistinct("road_id").alias("affected_road_count"),
        *[count_where(c("jam_level") == n).alias(f"jam_level{n}_cnt") for n in range(1, 6)],
        rounded(mean(c("congestion_rate"))).alias("avg_congestion_rate"), F.sum("traffic_flow").cast("long").alias("total_traffic_flow"))


def dws_device_health_day(status: DataFrame) -> DataFrame:
    return aggregate(status, ["device_id", "dt"], {
        "online_duration": count_where(c("online_flag") == "ONLINE"), "offline_count": count_where(c("online_flag") == "OFFLINE"),
        "avg_cpu_usage": rounded(mean(c("cpu_usage"))), "max_cpu_usage": F.max("cpu_usage").cast("double"),
        "avg_memory_usage": rounded(mean(c("memory_usage"))), "max_memory_usage": F.max("memory_usage").cast("double"),
        "avg_temperature": rounded(mean(c("temperature")), 1), "max_temperature": F.max("temperature").cast("double"),
        **{f"{f.lower()}_count": count_where(c("health_flag") == f) for f in ("ABNORMAL", "WARNING", "NORMAL")},
        "last_heartbeat": F.max(F.date_format("heartbeat_time", "yyyy-MM-dd HH:mm:ss")), "min_signal": F.min("signal_strength"),
            "avg_signal": rounded(mean(c("signal_strength")))})


def dws_alarm_day(alarms: DataFrame, by_device: bool = False) -> DataFrame:
    """Per type, level and day; by_device: per device too (the grain that the device indicators need)."""
    back = count_where(c("is_recovered") == "Y")
    return aggregate(alarms, [*["device_id"] * by_device, "alarm_type", "alarm_level", "dt"], {
        "total_alarm_count": F.count("*"), "recovered_count": back, "unrecovered_count": count_where(c("is_recovered") == "N"),
        "recovery_rate": rounded(percent(back, F.count("*"))), "avg_recover_minutes": rounded(mean(c("recover_duration_min"))),
        "max_recover_minutes": F.max("recover_duration_min"), "min_recover_minutes": F.min("recover_duration_min"),
        **({} if by_device else {"affected_device_count": F.countDistinct("device_id")}),
        **{f"{lv.lower()}_count": count_where(c("alarm_level") == lv) for lv in ALARM_LEVELS}})


def ads_traffic_operation(flow: DataFrame, jam: DataFrame, road: DataFrame, area: DataFrame) -> DataFrame:
    """Per area and hour; the jam table is summed to that grain before the join, so flows do not fan out.

    The area's peak hour (most flow, of equals the earliest) and busy hours are windows over its at most 24 rows of a day.
    """
    flows = with_current(flow, road.select("road_id", "area_id"), "road_id").groupBy("area_id", "hour", "dt").agg(
        F.sum("traffic_count").cast("long").alias("total_vehicle_flow"),
        rounded(F.sum("total_speed").cast("double") / F.sum("traffic_count")).alias("avg_speed_all"),
        F.max("traffic_count").alias("peak_flow"), F.countDistinct("road_id").alias("total_road_count"))
    affected = lambda cond: F.sum(F.when(cond, c("affected_road_count")).otherwise(0)).cast("long")
    jams = jam.groupBy("area_id", "hour", "dt").agg(
        affected(c("jam_level") >= 3).alias("jam_road_count"), affected(c("jam_level") == 5).alias("severe_jam_count"),
        rounded(F.avg("avg_congestion_rate")).alias("avg_congestion_rate"), F.max("avg_congestion_rate").alias("_most"))
    day = W.partitionBy("area_id", "dt")
    jams = jams.withColumn("peak_hour_duration", F.sum(F.when(c("_most") > 50, 1).otherwise(0)).over(day).cast("long")).drop("_most")
    busy = jams.select("area_id", "dt", "peak_hour_duration").distinct()
    top = F.max(F.struct(c("total_vehicle_flow").alias("f"), (-c("hour")).alias("h"))).over(day)
    flows = flows.withColumn("peak_hour", -top["h"])
    rows = flows.join(jams.drop("peak_hour_duration"), ["area_id", "hour", "dt"], "left").join(busy, ["area_id", "dt"], "left").join(area, "area_id")
    jammed = F.coalesce("jam_road_count", F.lit(0))
    return rows.select(
        "city_id", "city_name", "area_id", "area_name", "hour", period(c("hour")).alias("peak_period"), "total_vehicle_flow", "avg_speed_all",
            "peak_flow", "peak_hour",
        jammed.alias("jam_road_count"), rounded(percent(jammed, c("total_road_count"))).alias("jam_road_ratio"),
        F.coalesce("severe_jam_count", F.lit(0)).alias("severe_jam_count"), "avg_congestion_rate", "total_road_count",
        F.coalesce("peak_hour_duration", F.lit(0)).alias("peak_hour_duration"),
        rounded(percent(c("total_vehicle_flow"), c("total_road_count") * 3000)).alias("area_saturation"), "dt")


def top_rows(df: DataFrame, n: int, order: list, within: str = "dt") -> DataFrame:
    """rank_num 1 to n by `order` in each `within`; Spark limits each task's group before it shuffles."""
    own = W.partitionBy(within).orderBy(*order)
    return df.withColumn("rank_num", F.row_number().over(own)).filter(c("rank_num") <= n)


def ads_top_jam_roads(jam: DataFrame, road: DataFrame, area: DataFrame, n: int = 20) -> DataFrame:
    """Roads by the jam of their area: roads of one area tie, so the road id decides."""
    best = F.max(F.struct(c("avg_congestion_rate").alias("r"), (-c("hour")).alias("h"), c("peak_period").alias("p"))).alias("top")
    per = jam.groupBy("area_id", "dt").agg(
        rounded(F.avg("jam_level")).alias("avg_jam_level"), F.max("jam_level").alias("max_jam_level"),
            rounded(F.avg("avg_congestion_rate")).alias("avg_congestion_rate"),
        F.sum("total_traffic_flow").cast("long").alias("total_traffic_flow"), best)
    rows = per.join(area, "area_id").join(road, "area_id")
    rows = top_rows(rows, n, [c("avg_jam_level").desc(), c("avg_congestion_rate").desc(), c("road_id")])
    return rows.select("rank_num", "road_id", "road_name", "road_type", "area_id", "area_name", c("top.p").alias("peak_period"), "avg_jam_level",
        "max_jam_level", "avg_congestion_rate", "total_traffic_flow", (-c("top.h")).alias("peak_time"), "dt")


def ads_top_jam_roads_by_road(status: DataFrame, road: DataFrame, n: int = 20) -> DataFrame:
    """Roads by their own samples."""
    per = status.groupBy("road_id", "dt").agg(
        rounded(mean(c("jam_level"))).alias("avg_jam_level"), F.max("jam_level").alias("max_jam_level"),
            rounded(mean(c("congestion_rate"))).alias("avg_congestion_rate"), F.sum("traffic_flow").cast("long").alias("total_traffic_flow"))
    per = top_rows(per, n, [c("avg_jam_level").desc(), c("avg_congestion_rate").desc(), c("road_id")])
    return with_current(per, road.select("road_id", "road_name", "area_id"), "road_id")


def ads_device_health_score(health: DataFrame, alarm_device: DataFrame, device: DataFrame, road: DataFrame) -> DataFrame:
    alarms = alarm_device.filter(c("alarm_type").isin(ALARM_TYPES)).groupBy("device_id",
        "dt").agg(F.sum("total_alarm_count").cast("long").alias("total_alarm_count"), rounded(F.avg("recovery_rate")).alias("recovery_rate"))
    rows = health.join(device.select("device_id", "device_name", "device_type", "road_id"), "device_id").join(road.select("road_id", "area_id"),
        "road_id").join(alarms, ["device_id", "dt"], "left")
    samples = c("abnormal_count") + c("warning_count") + c("normal_count")
    online = percent(c("online_duration"), c("online_duration") + c("offline_count"))
    part_online = online / 100.0 * 40.0
    part_load = F.greatest(F.lit(0.0), 1.0 - (c("avg_cpu_usage") + c("avg_memory_usage")) / 200.0) * 30.0
    part_fault = F.greatest(F.lit(0.0), 1.0 - c("abnormal_count").cast("double") / F.nullif(samples.cast("double"), F.lit(0.0))) * 30.0
    score = rounded(part_online + part_load + part_fault)
    return rows.select(
        "device_id", "device_name", "device_type", "road_id", "area_id", rounded(online).alias("online_rate"), "avg_cpu_usage", "avg_memory_usage",
            "avg_temperature",
        rounded(percent(c("abnormal_count"), samples)).alias("abnormal_rate"), F.coalesce("total_alarm_count", F.lit(0)).alias("total_alarm_count"),
            F.coalesce("recovery_rate", F.lit(100.0)).alias("recovery_rate"),
        rounded(part_online).alias("online_score"), rounded(part_load).alias("resource_score"), rounded(part_fault).alias("fault_score"),
            score.alias("health_score"),
        band(score, HEALTH_GRADES, "CRITICAL").alias("health_level"), "dt")


def ads_device_mtbf_mttr(alarm_device: DataFrame, device: DataFrame, days: DataFrame) -> DataFrame:
    """Every device on every day of `days`(dt)."""
    per = alarm_device.groupBy("device_id", "dt").agg(F.sum("total_alarm_count").cast("long").alias("n"),
        F.sum("recovered_count").cast("long").alias("back"), rounded(F.avg("avg_recover_minutes")).alias("mttr"))
    rows = device.crossJoin(days).join(per, ["device_id", "dt"], "left")
    n = F.coalesce("n", F.lit(0))
    mtbf = F.when(n == 0, 1440.0).otherwise(1440.0 / n)
    return rows.select(
        "device_id", "device_name", "device_type", "manufacturer", "road_id", n.alias("total_alarm_count"),
            F.coalesce("back", F.lit(0)).alias("recovered_count"), F.lit(1440).alias("total_runtime_minutes"),
        rounded(mtbf).alias("mtbf_minutes"), F.coalesce("mttr", F.lit(0.0)).alias("mttr_minutes"), rounded(mtbf / 60.0).alias("mtbf_hours"),
            band(mtbf, RELIABILITY, "LOW").alias("reliability_rank"), "dt")


def ads_device_fault_top(health: DataFrame, device: DataFrame, road: DataFrame, area: DataFrame, n: int = 20) -> DataFrame:
    samples = c("abnormal_count") + c("warning_count") + c("normal_count")
    rate = percent(c("abnormal_count"), samples)
    rows = health.withColumn("fault_rate", rounded(rate)).withColumn("health_level", band(rate, FAULT_GRADES, "NORMAL"))
    rows = rows.join(device, "device_id").join(road.select("road_id", "area_id"), "road_id").join(area.select("area_id", "area_name"), "area_id")
    rows = top_rows(rows, n, [c("fault_rate").desc(), c("abnormal_count").desc(), c("device_id")])
    return rows.select(
        "rank_num", "device_id", "device_name", "device_type", "manufacturer", "road_id", "area_id", "area_name", "fault_rate", "abnormal_count",
            "warning_count", "offline_count",
        rounded(percent(c("online_duration"), c("online_duration") + c("offline_count"))).alias("online_rate"), "avg_cpu_usage", "avg_memory_usage",
            "avg_temperature", "health_level", "dt")


#: Each table as a function of the tables before it.
STEPS: dict[str, Callable[[Tables], DataFrame]] = {
    "dwd_vehicle_pass": lambda t: dwd_vehicle_pass(t["vehicle_pass"]),
    "dwd_traffic_status": lambda t: dwd_traffic_status(t["traffic_status"]),
    "dwd_device_status": lambda t: dwd_device_status(t["device_status"]),
    "dwd_alarm_log": lambda t: dwd_alarm_log(t["alarm_log"]),
    "dws_road_hour_flow": lambda t: dws_road_hour_flow(t["dwd_vehicle_pass"]),
    "dws_area_jam_hour": lambda t: dws_area_jam_hour(t["dwd_traffic_status"], t["road"], t["area"]),
    "dws_device_health_day": lambda t: dws_device_health_day(t["dwd_device_status"]),
    "dws_alarm_day": lambda t: dws_alarm_day(t["dwd_alarm_log"]),
    "dws_alarm_device_day": lambda t: dws_alarm_day(t["dwd_alarm_log"], by_device=True),
    "ads_traffic_operation": lambda t: ads_traffic_operation(t["dws_road_hour_flow"], t["dws_area_jam_hour"], t["road"], t["area"]),
    "ads_top_jam_roads": lambda t: ads_top_jam_roads(t["dws_area_jam_hour"], t["road"], t["area"]),
    "ads_top_jam_roads_by_road": lambda t: ads_top_jam_roads_by_road(t["dwd_traffic_status"], t["road"]),
    "ads_device_health_score": lambda t: ads_device_health_score(t["dws_device_health_day"], t["dws_alarm_device_day"], t["device"], t["road"]),
    "ads_device_mtbf_mttr": lambda t: ads_device_mtbf_mttr(t["dws_alarm_device_day"], t["device"], t["alarm_log"].select("dt").distinct()),
    "ads_device_fault_top": lambda t: ads_device_fault_top(t["dws_device_health_day"], t["device"], t["road"], t["area"]),
}
LAYERS = ("dwd", "dws", "ads")


class Warehouse(dict):
    """Landing tables and dimensions, with every further table made when it is first asked for."""

    def __init__(self, source: Callable[[str], DataFrame]):
        super().__init__()
        self.source = source

    def __missing__(self, name: str) -> DataFrame:
        self[name] = STEPS[name](self) if name in STEPS else self.source(name)
        return self[name]
