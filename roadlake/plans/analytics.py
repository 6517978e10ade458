"""Analytic queries over the warehouse tables: dashboards and question intents.

Each takes the table dictionary of `warehouse.build` and its parameters (dt, n,
order, area, device_type); without dt it answers for every day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import band, count_where, mean, percent, period, rounded
from .warehouse import Tables, top_rows

c = F.col


def on_day(df: DataFrame, dt: str | None) -> DataFrame:
    return df if dt is None else df.filter(c("dt") == dt)


def _order(col: str, order: str) -> Column:
    return c(col).desc() if order == "desc" else c(col).asc()


def flow_of_day(t: Tables, dt: str | None = None) -> DataFrame:
    return on_day(t["dws_road_hour_flow"], dt).groupBy("dt").agg(
        F.sum("traffic_count").cast("long").alias("total_flow"),
            rounded(F.sum("total_speed").cast("double") / F.sum("traffic_count")).alias("avg_speed"))


def flow_by_hour(t: Tables, dt: str | None = None, low: int = 0, high: int = 23) -> DataFrame:
    return on_day(t["dws_road_hour_flow"], dt).filter(c("hour").between(low, high)).groupBy("dt", "hour").agg(
        F.sum("traffic_count").cast("long").alias("total_flow"),
            rounded(F.sum("total_speed").cast("double") / F.sum("traffic_count")).alias("avg_speed"))


def jam_heat_map(t: Tables, dt: str | None = None) -> DataFrame:
    rows = on_day(t["dws_area_jam_hour"], dt).groupBy("dt", "area_id", "hour").agg(rounded(F.avg("avg_congestion_rate")).alias("congestion"),
        F.max("jam_level").alias("max_level"))
    return rows.join(t["area"].select("area_id", "area_name"), "area_id")


def top_jam(t: Tables, dt: str | None = None, n: int = 10) -> DataFrame:
    return on_day(t["ads_top_jam_roads"], dt).filter(c("rank_num") <= n)


def vehicle_types(t: Tables, dt: str | None = None) -> DataFrame:
    rows = on_day(t["dws_road_hour_flow"], dt).groupBy("dt").agg(*[F.sum(f"{k}_car_cnt").cast("long").alias(k) for k in ("small", "medium", "large",
        "other")])
    return rows.unpivot("dt", ["small", "medium", "large", "other"], "vehicle_type", "vehicles")


def per_area(t: Tables, dt: str | None = None) -> DataFrame:
    return on_day(t["ads_traffic_operation"], dt).groupBy("dt", "area_id", "area_name").agg(
        F.sum("total_vehicle_flow").cast("long").alias("flow"), rounded(F.avg("avg_congestion_rate")).alias("congestion"),
            F.sum("jam_road_count").cast("long").alias("jams"))


def hour_snapshot(t: Tables, hour: int, dt: str | None = None) -> DataFrame:
    """Measures of one hour; a day without rows in it gives those of the whole day (hour null)."""
    both = F.explode(F.when(c("hour") == hour, F.array(F.lit(hour), F.lit(None).cast("int"))).otherwise(F.array(F.lit(None).cast("int"))))
    flow = on_day(t["dws_road_hour_flow"], dt).select("dt", both.alias("h"), "traffic_count", "total_speed").groupBy("dt", "h").agg(
        F.sum("traffic_count").cast("long").alias("flow"), rounded(F.sum("total_speed").cast("double") / F.sum("traffic_count")).alias("avg_speed"))
    jam = on_day(t["dws_area_jam_hour"], dt).select("dt", both.alias("h"), "jam_level", "affected_road_count").groupBy("dt", "h").agg(
        *[F.sum(F.when(c("jam_level") == k, c("affected_road_count")).otherwise(0)).cast("long").alias(f"level{k}") for k in range(1, 6)])
    rows = flow.alias("f").join(jam.alias("j"), (c("f.dt") == c("j.dt")) & c("f.h").eqNullSafe(c("j.h")), "left").select("f.*",
        *[F.coalesce(f"level{k}", F.lit(0)).alias(f"level{k}") for k in range(1, 6)])
    return rows.groupBy("dt").agg(F.max_by(F.struct(c("h").alias("hour"), "flow", "avg_speed", *[f"level{k}" for k in range(1, 6)]),
        F.coalesce("h", F.lit(-1))).alias("s")).select("dt", "s.*")


def device_counts(t: Tables, dt: str | None = None) -> DataFrame:
    rows = on_day(t["dws_device_health_day"], dt).join(t["ads_device_health_score"].select("device_id", "dt", "health_score"), ["device_id", "dt"],
        "left")
    return rows.groupBy("dt").agg(F.count("*").alias("devices"), count_where(c("offline_count") == 0).alias("online"),
        count_where(c("offline_count") > 0).alias("offline"), count_where(c("health_score") < 60).alias("faulty"))


def online_trend(t: Tables, dt: str | None = None, days: int = 7) -> DataFrame:
    rows = t["dws_device_health_day"]
    if dt is not None:
        rows = rows.filter(c("dt").between(F.date_sub(F.lit(dt).cast("date"), days - 1).cast("string"), dt))
    return rows.groupBy("dt").agg(rounded(percent(F.sum("online_duration"), F.sum("online_duration") + F.sum("offline_count"))).alias("online_rate"))


def distribution(df: DataFrame, col: str, domain: list, keys: list[str]) -> DataFrame:
    """Rows for each value of the domain, zero-filled, within each key."""
    spark = df.sparkSession
    values = F.broadcast(spark.createDataFrame([(v,) for v in domain], df.select(col).schema))
    counts = df.groupBy(*keys, col).agg(F.count("*").alias("n"))
    return df.select(*keys).distinct().crossJoin(values).join(counts, [*keys, col], "left").select(*keys, col, F.coalesce("n", F.lit(0)).alias("n"))


def health_levels(t: Tables, dt: str | None = None) -> DataFrame:
    return distribution(on_day(t["ads_device_health_score"], dt), "health_level", ["EXCELLENT", "GOOD", "FAIR", "POOR", "CRITICAL"], ["dt"])


def worst_health(t: Tables, dt: str | None = None, n: int = 20, order: str = "asc", device_type: str | None = None) -> DataFrame:
    rows = on_day(t["ads_device_health_score"], dt)
    rows = rows if device_type is None else rows.filter(c("device_type") == device_type)
    return top_rows(rows, n, [_order("health_score", order), c("device_id")]).select("dt", "rank_num", "device_id", "device_name", "device_type",
        "health_score", "online_rate", "health_level")


def least_reliable(t: Tables, dt: str | None = None, n: int = 20) -> DataFrame:
    return top_rows(on_day(t["ads_device_mtbf_mttr"], dt), n, [c("mtbf_minutes"), c("device_id")]).select("dt", "rank_num", "device_id",
        "mtbf_minutes", "mttr_minutes", "reliability_rank")


def score_trend(t: Tables) -> DataFrame:
    return t["ads_device_health_score"].groupBy("dt").agg(F.count("*").alias("devices"),
        rounded(F.avg(c("health_score").cast("decimal(10,2)"))).alias("avg_score"))


def jam_ranking(t: Tables, n: int = 10, order: str = "desc") -> DataFrame:
    jam = t["dws_area_jam_hour"].groupBy("area_id").agg(
        rounded(F.avg("jam_level"), 4).alias("avg_jam_level"),
            rounded(F.avg(c("avg_congestion_rate").cast("decimal(10,2)")), 4).alias("avg_congestion_rate"),
                F.sum("total_traffic_flow").cast("long").alias("total_traffic_flow"))
    rows = jam.join(t["road"].select("road_id", "road_name", "road_type", "area_id"), "area_id").join(t["area"].select("area_id", "area_name"),
        "area_id")
    return rows.orderBy(_order("avg_congestion_rate", order), "road_id").limit(n).select("road_id", "road_name", "road_type", "area_name",
        "avg_jam_level", "avg_congestion_rate", "total_traffic_flow")


def flow_ranking(t: Tables, n: int = 10, order: str = "desc") -> DataFrame:
    flow = t["dws_road_hour_flow"].groupBy("road_id").agg(
        F.sum("traffic_count").cast("long").alias("total_flow"),
            rounded(F.sum("total_speed").cast("double") / F.sum("traffic_count")).alias("avg_speed"), F.max("traffic_count").alias("peak_flow"),
                F.countDistinct("hour").alias("active_hours"))
    return flow.join(t["road"].select("road_id", "road_name", "road_type"), "road_id").orderBy(_order("total_flow", order), "road_id").limit(n)


def fault_statistics(t: Tables, n: int = 10) -> DataFrame:
    rows = t["dws_alarm_device_day"].groupBy("device_id", "alarm_type", "alarm_level").agg(
        F.sum("total_alarm_count").cast("long").alias("alarm_count"), F.sum("recovered_count").cast("long").alias("recovered"),
            rounded(F.avg("avg_recover_minutes"), 1).alias("avg_recover_minutes"),
        rounded(percent(F.sum("recovered_count"), F.sum("total_alarm_count")), 1).alias("recovery_rate"))
    return rows.join(t["device"].select("device_id", "device_name", "device_type"), "device_id").orderBy(c("alarm_count").desc(), "device_id",
        "alarm_type", "alarm_level").limit(n)


def area_congestion(t: Tables) -> DataFrame:
    rows = t["dws_area_jam_hour"].groupBy("area_id").agg(
        rounded(F.avg(c("avg_congestion_rate").cast("decimal(10,2)"))).alias("avg_congestion"),
            F.max("avg_congestion_rate").alias("max_congestion"), count_where(c("jam_level") >= 4).alias("severe_jam_count"),
                F.sum("total_traffic_flow").cast("long").alias("total_flow"))
    return rows.join(t["area"].select("area_id", "area_name", "city_name"), "area_id")


def offline_devices(t: Tables, dt: str | None = None) -> DataFrame:
    rows = on_day(t["dws_device_health_day"], dt).filter("offline_count > 0").select("dt", "device_id", "offline_count", "last_heartbeat")
    return rows.join(t["device"].select("device_id", "device_name", "device_type", "road_id", "manufacturer"), "device_id")


def peak_analysis(t: Tables, area: str | None = None) -> DataFrame:
    rows = t["dws_area_jam_hour"].filter(c("peak_period").isin("MORNING_PEAK", "EVENING_PEAK")).groupBy("area_id", "hour", "peak_period").agg(
        rounded(F.avg(c("avg_congestion_rate").cast("decimal(10,2)"))).alias("avg_congestion"), rounded(F.avg("jam_level")).alias("avg_jam_level"),
            F.sum("total_traffic_flow").cast("long").alias("total_flow"))
    names = t["area"].select("area_id", "area_name")
    return rows.join(names if area is None else names.filter(c("area_name") == area), "area_id")


def quality_of_table(df: DataFrame, required: list[str], keys: list[str]) -> DataFrame:
    missing = F.lit(False)
    for k in required:
        missing = missing | c(k).isNull()
    distinct = F.countDistinct(*keys)
    return df.agg(F.count("*").alias("total"), count_where(missing).alias("null_rows"),
        rounded(100.0 - percent(count_where(missing), F.count("*"))).alias("completeness"), distinct.alias("unique_keys"),
            rounded(percent(distinct, F.count("*"))).alias("uniqueness"))


def road_trend(t: Tables, road_id: str) -> DataFrame:
    return t["dwd_traffic_status"].filter(c("road_id") == road_id).groupBy("dt",
        F.hour("sample_time").alias("hour")).agg(rounded(mean(c("jam_level"))).alias("avg_jam_level"),
            rounded(mean(c("congestion_rate"))).alias("avg_congestion_rate"))


def above_mean(t: Tables, factor: float = 1.5) -> DataFrame:
    """Roads whose flow of a day is over `factor` times the day's mean."""
    flow = t["dws_road_hour_flow"].groupBy("dt", "road_id").agg(F.sum("traffic_count").cast("long").alias("flow"))
    average = flow.groupBy("dt").agg((mean(c("flow")) * factor).alias("_limit"))
    return flow.join(average, "dt").filter(c("flow") > c("_limit")).drop("_limit")


def online_rate(t: Tables) -> DataFrame:
    return t["dwd_device_status"].groupBy("device_id").agg(F.count("*").alias("samples"),
        rounded(percent(count_where(c("online_flag") == "ONLINE"), F.count("*"))).alias("online_rate"))


def busiest_hours(t: Tables, n: int = 3) -> DataFrame:
    flow = t["dwd_vehicle_pass"].groupBy("dt", "hour").agg(F.count("*").alias("flow"))
    return top_rows(flow, n, [c("flow").desc(), c("hour")])


def road_detail(t: Tables) -> DataFrame:
    jam = t["dwd_traffic_status"].groupBy("road_id").agg(rounded(mean(c("jam_level"))).alias("avg_jam_level"))
    flow = t["dwd_vehicle_pass"].groupBy("road_id").agg(F.count("*").alias("flow"), rounded(mean(c("speed"))).alias("avg_speed"))
    return jam.join(flow, "road_id", "left").select("road_id", "avg_jam_level", F.coalesce("flow", F.lit(0)).alias("flow"), "avg_speed")


def passes_per_road(t: Tables, n: int = 10) -> DataFrame:
    flow = t["dwd_vehicle_pass"].groupBy("road_id").agg(F.count("*").alias("passes"), rounded(mean(c("speed"))).alias("avg_speed"))
    rows = flow.join(t["road"].select("road_id", "road_name", "area_id"), "road_id").join(t["area"].select("area_id", "area_name"), "area_id")
    return rows.orderBy(c("passes").desc(), "road_id").limit(n)


def day_overview(t: Tables) -> DataFrame:
    flow = t["dwd_vehicle_pass"].groupBy("dt").agg(F.count("*").alias("rows"), rounded(mean(c("speed"))).alias("avg_speed"))
    jam = t["dwd_traffic_status"].groupBy("dt").agg(rounded(mean(c("congestion_rate"))).alias("congestion"))
    score = score_trend(t)
    return flow.join(jam, "dt", "left").join(score, "dt", "left")


def compare_days(t: Tables) -> DataFrame:
    """Each road's flow of a day beside the day before."""
    flow = t["dws_road_hour_flow"].groupBy("road_id", "dt").agg(F.sum("traffic_count").cast("long").alias("flow"))
    before = flow.select("road_id", F.date_add(c("dt").cast("date"), 1).cast("string").alias("dt"), c("flow").alias("flow_before"))
    return flow.join(before, ["road_id", "dt"], "left").withColumn("change_pct", rounded(percent(c("flow") - c("flow_before"), c("flow_before"))))


def compare_areas(t: Tables, one: str, other: str) -> DataFrame:
    rows = t["ads_traffic_operation"].filter(c("area_id").isin(one, other)).groupBy("dt", "hour")
    return rows.agg(*[F.sum(F.when(c("area_id") == a, c("total_vehicle_flow"))).cast("long").alias(f"flow_{k}") for k,
        a in (("one", one), ("other", other))])


def recent_alarms(t: Tables, hours: int = 24) -> DataFrame:
    """Alarms of the last hours before the newest one."""
    rows = t["dwd_alarm_log"]
    last = rows.agg(F.max("alarm_time").alias("_last"))
    return rows.crossJoin(F.broadcast(last)).filter(F.unix_timestamp("_last") - F.unix_timestamp("alarm_time") <= hours * 3600).select("alarm_id",
        "device_id", "alarm_type", "alarm_level", "alarm_time")


def whole_table(t: Tables) -> DataFrame:
    """Metrics of several tables in one row."""
    one = lambda name, *aggs: t[name].agg(*aggs)
    out = one("dwd_vehicle_pass", F.count("*").alias("passes"), F.countDistinct("road_id").alias("roads"))
    for other in (one("dwd_alarm_log", F.count("*").alias("alarms")),
        one("dwd_device_status", F.count("*").alias("samples"), F.countDistinct("device_id").alias("devices"))):
        out = out.crossJoin(other)
    return out


def area_jam_bands(t: Tables, warn: float = 40, crit: float = 60) -> DataFrame:
    rows = t["dws_area_jam_hour"].groupBy("area_id", "dt",
        "hour").agg(rounded(percent(F.sum(F.when(c("jam_level") >= 3, c("affected_road_count")).otherwise(0)),
            F.sum("affected_road_count"))).alias("jam_rate"))
    return rows.withColumn("level", band(c("jam_rate"), [(crit, "CRITICAL"), (warn, "WARNING")], "NORMAL")).withColumn("period", period(c("hour")))
