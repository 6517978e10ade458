"""Sources and sinks: topics, text and JSON decoding, landing files, extracts, partitioned tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import CDC, FEEDS, LOG, MAX_BACKFILL_DAYS


def read_feed(spark: SparkSession, feed: str, source: str = "kafka", options: dict[str, str] | None = None) -> DataFrame:
    """A stream of (value, collect_time); `source` is any streaming format that gives text, such as kafka or text."""
    assert feed in FEEDS
    reader = spark.readStream.format(source).options(**(options or {}))
    if source == "kafka":
        reader = reader.option("subscribe", feed).option("startingOffsets", (options or {}).get("startingOffsets", "earliest"))
    return reader.load().select(F.col("value").cast("string").alias("value"), F.current_timestamp().alias("collect_time"))


def decode_text(df: DataFrame, schema: str, sep: str = "\t") -> DataFrame:
    """Positional text to columns; a row that does not fit keeps its text in _corrupt."""
    parsed = F.from_csv("value", f"{schema}, _corrupt string",
        {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "nullValue": "", "quote": ""})
    return df.select("*", parsed.alias("_r")).select(*[c for c in df.columns if c != "value"], "_r.*")


def decode_json(df: DataFrame, schema: str) -> DataFrame:
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.select("*", parsed.alias("_r")).select(*[c for c in df.columns if c != "value"], "_r.*")


def decode_cdc(df: DataFrame, table: str, columns: list[str], keep_deletes: bool = True) -> DataFrame:
    """Change records of one table: type, ts, xoffset and its columns as text."""
    rows = df.select(F.from_json("value", CDC).alias("r")).select("r.*").filter(F.col("table") == table)
    rows = rows if keep_deletes else rows.filter("type <> 'delete'")
    return rows.select("type", "ts", "xoffset", *[F.try_element_at("data", F.lit(c)).alias(c) for c in columns])


def encode_cdc(changes: DataFrame, database: str, table: str) -> DataFrame:
    """The change records of a table as JSON text `value`: type, ts, xid and xoffset as given, every other column as data."""
    head = ["type", "ts", "xid", "xoffset"]
    data = F.struct(*[c for c in changes.columns if c not in head])
    return changes.select(F.to_json(F.struct(F.lit(database).alias("database"), F.lit(table).alias("table"), *head,
        data.alias("data"))).alias("value"))


def read_landing(spark: SparkSession, path: str, schema: str, day: str | None = None) -> DataFrame:
    """Tab-separated text under dt=... folders, the empty string as null; a line that does not fit keeps its text in _corrupt."""
    rows = decode_text(spark.read.schema("value string, dt string").text(path), schema)
    return rows if day is None else rows.filter(F.col("dt") == day)


def read_json(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """JSON lines, or files that hold one array each."""
    return spark.read.json(path, schema=schema, multiLine=array)


def extract(source: DataFrame, columns: list[str], low: str | None = None, high: str | None = None, at: str = "updated_at") -> DataFrame:
    """Full, or the rows of low <= at < high; the predicate reaches the source."""
    rows = source
    if low is not None:
        rows = rows.filter(F.col(at) >= low)
    if high is not None:
        rows = rows.filter(F.col(at) < high)
    return rows.select(*columns)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 8,
    **options: str) -> DataFrame:
    """A relational table; with `column`, read in `parts` ranges of it."""
    more = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)} if column else {}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **more, **options).load()


def full_extract(source: DataFrame, columns: list[str], path: str, day: str, format: str = "orc") -> None:
    """The whole source as the partition dt = day of a table; other days stay."""
    write_dt(extract(source, columns).withColumn("dt", F.lit(day)), path, format)


class BadRecords(ValueError):
    pass


def within_budget(df: DataFrame, max_rows: int, max_share: float, corrupt: str = "_corrupt") -> DataFrame:
    """The good rows; raises where bad rows are over max_rows or over max_share per cent of all."""
    bad, total = df.agg(F.count(F.col(corrupt)), F.count(F.lit(1))).first()
    if bad > max_rows or (total and 100.0 * bad / total > max_share):
        raise BadRecords(f"{bad} of {total} records are bad")
    return df.filter(F.col(corrupt).isNull()).drop(corrupt)


def write_dt(df: DataFrame, path: str, format: str = "orc", bloom: list[str] | None = None, by: str = "dt") -> None:
    """Overwrites the partitions that occur in df and no others.

    Rows are brought together by partition, and a large partition is split into files of about
    spark.sql.adaptive.advisoryPartitionSizeInBytes, so no day is one task's work.
    """
    writer = df.hint("rebalance", by).write.mode("overwrite").format(format)
    writer = writer.option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
    if bloom and format == "orc":
        writer = writer.option("orc.bloom.filter.columns", ",".join(bloom))
    writer.partitionBy(by).save(path)


def register(spark: SparkSession, table: str, path: str, format: str = "orc") -> None:
    """An external table over a path with its partitions found."""
    spark.sql(f"create table if not exists {table} using {format} location '{path}'")
    spark.sql(f"msck repair table {table}")


def structure_logs(df: DataFrame) -> DataFrame:
    """day, component, job, level, message of JSON or plain log lines; secret fields never leave."""
    rows = df.select("value", F.from_json("value", LOG).alias("j"))
    plain = r"^\[?(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)[^\]]*\]?\s+\[?(\w+)\]?\s+([\w.-]+)\s*[:-]\s*(.*)$"
    pick = lambda field, group: F.coalesce(F.col(f"j.{field}"), F.nullif(F.regexp_extract("value", plain, group), F.lit("")))
    rows = rows.select(F.try_to_timestamp(F.replace(pick("timestamp", 1), F.lit("T"), F.lit(" "))).alias("at"), pick("job", 3).alias("job"),
        F.upper(pick("level", 2)).alias("level"), F.coalesce(pick("message", 4), "value").alias("message"))
    job = F.lower("job")
    kinds = [("stream", job.contains("flink") | job.contains("stream")), ("topic", job.contains("kafka")), ("warehouse", job.contains("hive")),
        ("etl", job.contains("etl"))]
    component = F.coalesce(*[F.when(cond, name) for name, cond in kinds], F.lit("other"))
    hidden = F.regexp_replace("message", r"(?i)(password|secret|token)=\S+", "$1=***")
    return rows.select(F.to_date("at").cast("string").alias("day"), component.alias("component"), "job", "level", hidden.alias("message"), "at")


def write_logs(logs: DataFrame, path: str) -> None:
    """Structured logs as daily partitions; a day that occurs is written anew."""
    write_dt(logs.withColumn("day", F.coalesce("day", F.lit("unknown"))), path, "json", by="day")


def write_json(df: DataFrame, path: str) -> None:
    """A report (quality checks, lineage) as JSON lines."""
    df.write.mode("overwrite").json(path)


def backfill(run: Callable[[str, str], None], start: str, end: str, as_of: str, max_days: int = MAX_BACKFILL_DAYS) -> None:
    """run(start, end) for a range at most max_days back from as_of."""
    a, b, now = map(dt.date.fromisoformat, (start, end, as_of))
    if a > b or b > now or (now - a).days > max_days:
        raise ValueError(f"{start} to {end} is not within {max_days} days before {as_of}")
    run(start, end)
