"""The daily run: every layer in order, each read back from its table, quality last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..sources.io import backfill, write_dt
from .warehouse import LAYERS, STEPS, Warehouse

DIMS = {"road", "device", "area"}
#: Landing table: columns that must not be null.
REQUIRED = {
    "vehicle_pass": ["vehicle_id", "road_id", "pass_time"], "traffic_status": ["road_id", "sample_time"],
    "device_status": ["device_id", "heartbeat_time"], "alarm_log": ["alarm_id", "device_id", "alarm_time"],
}
#: Detail table: its key.
KEYS = {
    "dwd_vehicle_pass": ["vehicle_id", "pass_time"], "dwd_traffic_status": ["road_id", "sample_time"],
    "dwd_device_status": ["device_id", "heartbeat_time"], "dwd_alarm_log": ["alarm_id"],
}
#: Landing table: rules that each row should keep, over text or typed columns.
VALID = {
    "vehicle_pass": {"speed": "try_cast(speed as int) between 0 and 200"},
    "traffic_status": {"jam_level": "try_cast(jam_level as int) between 1 and 5",
        "congestion_rate": "try_cast(congestion_rate as decimal(5,2)) between 0 and 100"},
    "device_status": {
        "cpu_usage": "try_cast(cpu_usage as decimal(5,2)) between 0 and 100",
            "memory_usage": "try_cast(memory_usage as decimal(5,2)) between 0 and 100",
        "online_flag": "online_flag in ('ONLINE', 'OFFLINE', 'UNKNOWN')",
    },
    "alarm_log": {"alarm_level": "alarm_level in ('CRITICAL', 'MAJOR', 'MINOR', 'WARNING')"},
}


def checks(tables: dict[str, DataFrame], offsets: DataFrame | None = None) -> DataFrame:
    """Completeness and validity of the landing tables, uniqueness of the detail tables, and the backlog of `offsets` if given."""
    found = [quality.completeness(tables[n], cols, n) for n, cols in REQUIRED.items() if n in tables]
    found += [quality.uniqueness(tables[n], keys, n) for n, keys in KEYS.items() if n in tables]
    found += [quality.validity(tables[n], {k: F.expr(e) for k, e in rules.items()}, n) for n, rules in VALID.items() if n in tables]
    if offsets is not None:
        found.append(quality.backlog(offsets, "topics"))
    return reduce(DataFrame.unionByName, found)


def run_range(spark: SparkSession, landing: dict[str, DataFrame], root: str, start: str, end: str, format: str = "parquet",
    offsets: DataFrame | None = None) -> DataFrame:
    """Builds the days start to end of all tables under root by dynamic overwrite; returns the quality report, a row a day."""
    source = lambda name: landing[name] if name in DIMS else landing[name].filter(F.col("dt").between(start, end))
    written = lambda name: _read(spark, root, name, start, end, format)
    for layer in LAYERS:
        tables = Warehouse(lambda name: source(name) if name in landing else written(name))
        for lower in STEPS:
            if LAYERS.index(lower[:3]) < LAYERS.index(layer):
                tables[lower] = written(lower)
        for name in STEPS:
            if name.startswith(layer):
                write_dt(STEPS[name](tables), f"{root}/{name}", format)
    tables = {**{n: source(n) for n in REQUIRED}, **{n: written(n) for n in KEYS}}
    return quality.report(checks(tables, offsets))


def _read(spark: SparkSession, root: str, name: str, start: str, end: str, format: str) -> DataFrame:
    rows = spark.read.format(format).load(f"{root}/{name}")
    return rows.withColumn("dt", F.col("dt").cast("string")).filter(F.col("dt").between(start, end))


def run_day(spark: SparkSession, landing: dict[str, DataFrame], root: str, day: str, format: str = "parquet") -> DataFrame:
    return run_range(spark, landing, root, day, day, format)


def replay(spark: SparkSession, landing: dict[str, DataFrame], root: str, start: str, end: str, as_of: str, format: str = "parquet") -> DataFrame:
    """run_range for past days, refused beyond the days that a backfill may reach back."""
    reports: list[DataFrame] = []
    backfill(lambda a, b: reports.append(run_range(spark, landing, root, a, b, format)), start, end, as_of)
    return reports[0]
