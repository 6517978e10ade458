"""Table maintenance: retention, compaction, file profiles."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def partitions(spark: SparkSession, path: str, by: str = "dt") -> list[str]:
    """Values of the partition folders, from the file system's listing."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{by}="))


def drop_expired(spark: SparkSession, path: str, date: str, days: int = 90, by: str = "dt") -> list[str]:
    """Drops partitions older than `days` before date and touches no other."""
    limit = spark.range(1).select(F.date_sub(F.lit(date).cast("date"), days).cast("string")).first()[0]
    gone = [v for v in partitions(spark, path, by) if v < limit]
    for v in gone:
        fs, p = _fs(spark, f"{path}/{by}={v}")
        fs.delete(p, True)
    return gone


def files(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """path and size of each data file, from Spark's file metadata."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{format}").load(path).select("path",
        F.col("length").alias("size"))


def file_profile(spark: SparkSession, path: str, format: str = "parquet", by: str = "dt") -> DataFrame:
    rows = files(spark, path, format).withColumn(by, F.regexp_extract("path", rf"{by}=([^/]+)", 1))
    return rows.groupBy(by).agg(F.count("*").alias("file_count"), F.round(F.sum("size") / 1048576.0, 6).alias("total_mb"),
        F.round(F.avg("size") / 1024.0, 6).alias("avg_kb"))


def _swap(spark: SparkSession, rows: DataFrame, path: str, format: str) -> None:
    """Writes beside the folder, then puts the new one in its place; if that fails the old one comes back.

    Between the two renames a plain folder has no rows for a moment: tables with readers at any time are kept by versions.py.
    """
    side = f"{path}.{uuid.uuid4().hex}"
    rows.write.format(format).save(side)
    fs, old = _fs(spark, path)
    new, trash = spark._jvm.org.apache.hadoop.fs.Path(side), spark._jvm.org.apache.hadoop.fs.Path(f"{side}.old")
    if not fs.rename(old, trash):
        fs.delete(new, True)
        raise OSError(f"could not replace {path}")
    if not fs.rename(new, old):
        fs.rename(trash, old)
        raise OSError(f"could not replace {path}; its rows are where they were")
    fs.delete(trash, True)


def compact(spark: SparkSession, path: str, target_mb: float = 256, format: str = "parquet") -> int:
    """Rewrites one partition folder in files of about target_mb; returns how many."""
    total = files(spark, path, format).agg(F.sum("size")).first()[0] or 0
    n = max(1, math.ceil(total / (target_mb * 1048576)))
    _swap(spark, spark.read.format(format).load(path).repartition(n), path, format)
    return n


def compact_by(spark: SparkSession, path: str, unit: str, ts: str, format: str = "parquet") -> None:
    """One file for each three hours ("3h") or day ("day") of `ts` that occurs; rows without a time go to the first."""
    rows = spark.read.format(format).load(path)
    seconds = 86400 if unit == "day" else 3 * 3600
    bucket = F.floor(F.unix_timestamp(ts) / seconds)
    # Buckets that occur, numbered in order: one row each. A time far off makes one file more, not one for each bucket on the way.
    occur = rows.select(bucket.alias("_bucket")).distinct()
    numbers = occur.select("_bucket", (F.row_number().over(W.orderBy(F.col("_bucket").asc_nulls_first())) - 1).alias("_file"))
    numbers = cut(numbers)
    n = max(1, numbers.count() - numbers.filter("_bucket is null").count())
    shift = F.lit(1 if numbers.filter("_bucket is null").count() else 0)
    dealt = rows.join(F.broadcast(numbers), bucket.eqNullSafe(F.col("_bucket")))  # one row a bucket of time
    number = F.greatest(F.col("_file") - shift, F.lit(0))
    _swap(spark, dealt.repartitionById(n, number).drop("_bucket", "_file"), path, format)


def compact_recent(spark: SparkSession, roots: list[str], days: int, target_mb: float = 256, format: str = "parquet", by: str = "dt") -> dict[str,
    int]:
    """compact() over the newest partitions of several tables."""
    return {f"{r}/{by}={v}": compact(spark, f"{r}/{by}={v}", target_mb, format) for r in roots for v in partitions(spark, r, by)[-days:]}
