"""Queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.roles import role
from .oracle import WAREHOUSE, sql
from .warehouse import Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines hand over one type."""
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema.fields if f.dataType.typeName() == "decimal"})


def add(name: str, oracle: str | None, **more: str):
    """Registers a function of the warehouse tables; oracle: its SQL over them."""

    def put(f: Callable[[dict[str, DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(f(Warehouse(lambda table: role(spark, sf_dir, table))))
        if oracle is not None:
            SQL[name] = sql(oracle, **more)
        return f

    return put


for _id, _table in {
    "p_dwd1": "dwd_vehicle_pass", "p_dwd2": "dwd_traffic_status", "p_dwd3": "dwd_device_status", "p_dwd4": "dwd_alarm_log",
    "p_dws1": "dws_road_hour_flow", "p_dws2": "dws_area_jam_hour", "p_dws3": "dws_device_health_day", "p_dws4": "dws_alarm_day",
        "p_dws4d": "dws_alarm_device_day",
    "p_ads1": "ads_traffic_operation", "p_ads2": "ads_top_jam_roads", "p_ads2r": "ads_top_jam_roads_by_road", "p_ads3": "ads_device_health_score",
    "p_ads4": "ads_device_mtbf_mttr", "p_ads5": "ads_device_fault_top",
}.items():
    assert _table in WAREHOUSE
    _casts = {"dwd_traffic_status": "* replace (cast(congestion_rate as double) as congestion_rate)",
              "dwd_device_status": "* replace (cast(cpu_usage as double) as cpu_usage, cast(memory_usage as double) as memory_usage, cast(temperature as double) as temperature)"}
    add(f"{_id}_{_table}", f"select {_casts.get(_table, '*')} from {_table}")(lambda t, _table=_table: t[_table])
