"""Registers the sources and sinks: feeds and tables derived from the data are written, read back and decoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import io
from ..sources.schemas import TRAFFIC_STATUS
from ..sources.shared import shared_dir
from .registry import add

_TEXT = """
select road_id, cast(avg_speed as string) as avg_speed, cast(traffic_flow as string) as traffic_flow, cast(jam_level as string) as jam_level,
  cast(congestion_rate as string) as congestion_rate, peak_flag, cast(sample_time as string) as sample_time
from traffic_status
"""


def _folder(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/feeds-{uuid.uuid4().hex}"


@add("s2_decode_text", _TEXT)
def _(t):
    return io.decode_text(t["status_text"].select("value"), TRAFFIC_STATUS).drop("_corrupt")


@add("s3_decode_json", "select road_id, avg_speed, jam_level from traffic_status")
def _(t):
    return io.decode_json(t["status_json"], "road_id string, avg_speed int, jam_level int").drop("_corrupt")


@add("s4_landing_text", _TEXT.replace("as sample_time", "as sample_time, dt"))
def _(t):
    path = _folder(t["status_text"])
    t["status_text"].write.partitionBy("dt").text(path)
    return io.read_landing(t["status_text"].sparkSession, path, TRAFFIC_STATUS).drop("_corrupt")


@add("s5_json_lines", "select road_id, avg_speed, jam_level from traffic_status")
def _(t):
    path = _folder(t["status_json"])
    t["status_json"].write.text(path)
    return io.read_json(t["status_json"].sparkSession, path, "road_id string, avg_speed int, jam_level int")


@add("s7_incremental_extract", """
select o_orderkey, o_custkey from orders where o_orderdate >= '1996-01-01' and o_orderdate < '1996-02-01'
""")
def _(t):
    return io.extract(t["orders"], ["o_orderkey", "o_custkey"], "1996-01-01", "1996-02-01", at="o_orderdate")


@add("s8_within_budget", _TEXT)
def _(t):
    rows = io.decode_text(t["status_text"].select("value"), TRAFFIC_STATUS)
    return io.within_budget(rows, 0, 1.0)


@add("s10_change_records", """
select case s_suppkey % 5 when 1 then 'insert' else 'update' end as type, 1717804800 + s_suppkey as ts, s_suppkey as xoffset,
  concat('R', s_suppkey) as road_id, cast(s_suppkey % 5 * 20 + 40 as string) as speed_limit
from supplier where s_suppkey % 9 <> 0 and s_suppkey % 5 <> 0
""")
def _(t):
    return io.decode_cdc(t["road_changes"], "road", ["road_id", "speed_limit"], keep_deletes=False)


@add("s11_partition_overwrite", """
select road_id, jam_level, dt from traffic_status where dt not in (select max(dt) from traffic_status)
union all select road_id, 9, dt from traffic_status where dt in (select max(dt) from traffic_status)
""")
def _(t):
    """The newest day is written again with other values; the days before stay."""
    rows, path = t["traffic_status"].select("road_id", "jam_level", "dt"), _folder(t["traffic_status"])
    io.write_dt(rows, path, "parquet")
    newest = rows.agg(F.max("dt")).first()[0]
    io.write_dt(rows.filter(F.col("dt") == newest).withColumn("jam_level", F.lit(9)), path, "parquet")
    out = rows.sparkSession.read.parquet(path)
    return out.withColumn("dt", F.col("dt").cast("string"))


@add("s19_structured_logs", """
select cast(cast(ts as date) as string) as day, 'row ' || event_id || ' token=***' as message, 'INFO' as level,
  case event_id % 3 when 0 then 'stream' when 1 then 'warehouse' else 'etl' end as component,
  case event_id % 3 when 0 then 'flink-count' when 1 then 'hive-load' else 'etl-day' end as job
from events where event_id % 2 = 0
union all select cast(cast(ts as date) as string), 'it failed at ' || event_id, 'ERROR', 'topic', 'kafka-feed' from events where event_id % 2 <> 0
""")
def _(t):
    return io.structure_logs(t["job_logs"]).select("day", "message", "level", "component", "job")
