"""Registers isolation forests of fixed trees, whose scores SQL repeats by walking the same table of trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators.anomaly import IForest, average_depth, flow_features, grow, summary, with_cause
from .registry import add

_TREES, _SIZE, _PLACES = 8, 64, 6


def _fixed(ranges: list[tuple[float, float]], seed: int) -> list[np.ndarray]:
    """Trees grown on uniform rows over the ranges of the features."""
    low, high = np.array(ranges, float).T
    rng = np.random.default_rng(seed)
    return [np.array(grow(rng.uniform(low, high, (_SIZE, len(ranges))), seed + i)) for i in range(_TREES)]


def _double(x: float) -> str:
    return repr(float(x)) if "e" in repr(float(x)) else f"{float(x)!r}e0"


def _sql(trees: list[np.ndarray], rows: str, columns: list[str]) -> dict[str, str]:
    """Named parts: forest, rows (r and the features), walk, scored (r, score, limit)."""
    values = ", ".join(f"({t}, {i}, {int(c)}, {_double(cut)}, {int(low)}, {int(high)})" for t, nodes in enumerate(trees) for i, (c, cut, low, high) in enumerate(nodes.tolist()))
    feature = "case f.col " + " ".join(f"when {i} then {c}" for i, c in enumerate(columns)) + " end"
    norm = float(average_depth(_SIZE))
    return {
        "forest": f"select * from (values {values}) v(t, node, col, cut, low, high)",
        "given": rows,
        "walk": f"""select r, {', '.join(columns)}, t, 0 as node from given, (select distinct t from forest)
          where {' and '.join(f'{c} is not null' for c in columns)}
          union all select w.r, {', '.join(f'w.{c}' for c in columns)}, w.t, case when {feature} < f.cut then f.low else f.high end
          from walk w join forest f on f.t = w.t and f.node = w.node where f.col >= 0""",
        "scores": f"""select r, round(pow(2.0e0, -(cast(sum(cast(round(cut, {_PLACES}) as decimal(18, {_PLACES}))) as double) / {_TREES}.0e0) / {_double(norm)}), {_PLACES}) as score
          from walk w join forest f on f.t = w.t and f.node = w.node where f.col < 0 group by r""",
        "cutoff": "select score as least from scores qualify row_number() over (order by score desc) = (select greatest(1, cast(floor(count(*) * 0.05e0) as bigint)) from scores)",
        "found": "select g.*, s.score, coalesce(s.score > (select least from cutoff), false) as is_anomaly from given g left join scores s on s.r = g.r",
    }


_DEVICE = _fixed([(0, 105), (0, 100), (0, 110)], 7)
_DEVICE_ROWS = """select row_number() over (order by device_id, heartbeat_time, cpu_usage, memory_usage, temperature) as r, device_id, heartbeat_time, cast(cpu_usage as double) as cpu, cast(memory_usage as double) as mem,
  cast(temperature as double) as temp from dwd_device_status"""
_FLOW = _fixed([(0, 12), (0, 24), (0, 1.5), (0, 1.5)], 11)
_FLOW_ROWS = """select row_number() over (order by road_id, dt, hour, traffic_count) as r, road_id, dt, cast(hour as double) as hour, cast(traffic_count as double) as flow,
  case when hour between 7 and 9 then 1.0e0 else 0.0e0 end as morning, case when hour between 17 and 19 then 1.0e0 else 0.0e0 end as evening from dws_road_hour_flow"""
_DEVICE_SQL = _sql(_DEVICE, _DEVICE_ROWS, ["cpu", "mem", "temp"])


def _device(t):
    rows = t["dwd_device_status"].select("device_id", "heartbeat_time", *[F.col(c).cast("double").alias(n) for c, n in (("cpu_usage", "cpu"), ("memory_usage", "mem"), ("temperature", "temp"))])
    return IForest.of(_DEVICE, _SIZE, ["cpu", "mem", "temp"]).score_by_joins(rows, _PLACES)


add("n1_fixed_forest", "select device_id, heartbeat_time, score, is_anomaly from found", **_DEVICE_SQL)(lambda t: _device(t).drop("cpu", "mem", "temp"))


@add("n2_fixed_forest", "select road_id, dt, hour, flow, score, is_anomaly from found", **_sql(_FLOW, _FLOW_ROWS, ["flow", "hour", "morning", "evening"]))
def _(t):
    rows = flow_features(t["dws_road_hour_flow"].select("road_id", "dt", F.col("hour").cast("double").alias("hour"), F.col("traffic_count").cast("double").alias("flow")))
    return IForest.of(_FLOW, _SIZE, ["flow", "hour", "morning", "evening"]).score_by_joins(rows, _PLACES).drop("morning", "evening")


@add("n3_fixed_forest", """
select device_id, heartbeat_time, score, is_anomaly,
  case when is_anomaly then case when temp > 80 then 'TEMP_HIGH' when cpu > 90 then 'CPU_HIGH' when mem > 90 then 'MEMORY_HIGH' else 'COMBINED' end end as cause
from found
""", **_DEVICE_SQL)
def _(t):
    return with_cause(_device(t)).drop("cpu", "mem", "temp")


@add("n5_fixed_forest", """
select count(*) as total, count(*) filter (where is_anomaly) as anomalies,
  case when count(*) filter (where is_anomaly) = 0 then 'NORMAL' when count(*) filter (where is_anomaly) < 5 then 'WARNING' else 'CRITICAL' end as level
from found
""", **_DEVICE_SQL)
def _(t):
    return summary(_device(t))
