"""The device rules and their alerts: matching, formatting, suppression, sinks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import series
from . import stateful

#: Rule, alert level, condition on a heartbeat, rows in a row, seconds that they lie within, reason.
RULES = [
    ("OFFLINE", "CRITICAL", "online_flag = 'OFFLINE'", 3, 180, "continuous offline"),
    ("CPU_HIGH", "MAJOR", "cpu_usage > 90", 3, 300, "CPU usage exceeds 90%"),
    ("TEMP_HIGH", "MAJOR", "temperature > 80", 2, 600, "temperature exceeds 80°C"),
    ("HIGH_FREQ", "CRITICAL", "online_flag is not null", 10, 300, "high frequency alerts (>10 in 5min)"),
]
Rules = list[tuple[str, str, str, int, int, str]]


def matches(df: DataFrame, key: str = "device_id", ts: str = "heartbeat_time", rules: Rules = RULES, delay: str = "30 seconds") -> DataFrame:
    """key, rule, first_ts, last_ts of every match of every rule; of a stream in one pass, of a table rule by rule."""
    if df.isStreaming:
        out = stateful.sequence_stream(df, key, ts, {name: (F.expr(cond), n, within) for name, _, cond, n, within, _ in rules}, delay)
        return out.withColumnRenamed("key", key)
    found = [series.sequence(df, key, ts, F.expr(cond), n, within).withColumn("rule", F.lit(name)) for name, _, cond, n, within, _ in rules]
    return reduce(DataFrame.unionByName, found).select(key, "rule", "first_ts", "last_ts")


def _of_rule(rules: Rules, place: int) -> Column:
    return F.coalesce(*[F.when(F.col("rule") == r[0], F.lit(r[place])) for r in rules])


def alert_rows(found: DataFrame, key: str = "device_id", rules: Rules = RULES) -> DataFrame:
    """alert_level, alert_type, the key, first_ts, last_ts and the message of each match."""
    message = F.format_string("Device %s %s detected at %d", F.col(key), _of_rule(rules, 5), F.unix_millis("last_ts"))
    return found.select(_of_rule(rules, 1).alias("alert_level"), F.col("rule").alias("alert_type"), key, "first_ts", "last_ts",
        message.alias("message"))


def alert_text(alerts: DataFrame) -> DataFrame:
    """The delimited text of the alert topic."""
    return alerts.select(F.concat_ws("|", F.lit("ALERT"), "alert_level", "alert_type", "message").alias("value"))


def alerts_of(heartbeats: DataFrame, key: str = "device_id", ts: str = "heartbeat_time", rules: Rules = RULES, minutes: int = 30,
    delay: str = "30 seconds") -> DataFrame:
    """A stream of heartbeats to the alerts to be sent: rules, alert rows, and one of a device and kind in `minutes`."""
    found = alert_rows(matches(heartbeats, key, ts, rules, delay), key, rules)
    return stateful.suppress_stream(found, [key, "alert_type"], "last_ts", minutes, delay=None)


def text_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of alert text; a batch has its own folder, so a repeated one does not double alerts."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        alert_text(batch).write.mode("overwrite").text(f"{path}/batch={batch_id}")

    return sink


def to_topic(alerts: DataFrame, servers: str, checkpoint: str, topic: str = "device_alarm"):
    """Runs the alerts into a topic as text."""
    writer = alert_text(alerts).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("checkpointLocation", checkpoint).start()
