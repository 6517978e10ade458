"""What a stream has not read yet: offsets from its progress, or from its checkpoint when it does not run."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .serving import _children

OFFSETS = "dt string, part string, end_offset long, committed long"


def progress_offsets(progress: dict, day: str | None = None) -> list[tuple[str, str, int, int]]:
    """(dt, part, end_offset, committed) of each topic partition in a query's progress, for quality.backlog.

    committed is where the last batch ended, end_offset what the source had then. Sources that do not report offsets by
    topic and partition (files) are left to `file_backlog`.
    """
    out = []
    for source in progress["sources"]:
        end, latest = (source.get(k) for k in ("endOffset", "latestOffset"))
        end, latest = (json.loads(x) if isinstance(x, str) else x for x in (end, latest))
        if not isinstance(end, dict) or not isinstance(latest, dict):
            continue
        for topic, parts in latest.items():
            if isinstance(parts, dict):
                done = end.get(topic) or {}
                out += [(day or progress["timestamp"][:10], f"{topic}-{p}", int(n), int(done.get(p, 0))) for p, n in sorted(parts.items())]
    return out


def committed_offsets(spark: SparkSession, checkpoint: str) -> list[dict | None]:
    """The offset of each source after the last committed batch of a checkpoint; empty before the first."""
    done = [int(n) for n in _children(spark, f"{checkpoint}/commits", "") if n.isdigit()]
    if not done:
        return []
    lines = [r.value for r in spark.read.text(f"{checkpoint}/offsets/{max(done)}").collect()]  # a header and one line a source
    return [None if line == "-" else json.loads(line) for line in lines[2:]]


def read_files(spark: SparkSession, checkpoint: str, source: int = 0) -> DataFrame:
    """path of the input files that the committed batches of a file source have read, from its log."""
    offsets = committed_offsets(spark, checkpoint)
    log = f"{checkpoint}/sources/{source}"
    if len(offsets) <= source or offsets[source] is None or not _children(spark, log, ""):
        return spark.createDataFrame([], "path string")
    lines = spark.read.text(log).filter(F.startswith("value", F.lit("{"))).select(F.from_json("value", "path string, batchId long").alias("f"))
    return lines.filter(F.col("f.batchId") <= offsets[source]["logOffset"]).select(_plain(F.col("f.path")).alias("path")).distinct()


def _plain(path: Column) -> Column:
    """A path without scheme and doubled slashes, percent signs decoded, as logs and listings write them differently."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^[A-Za-z][\w+.-]*:/+", "/")


def file_backlog(spark: SparkSession, checkpoint: str, path: str, day: str, format: str = "parquet", source: int = 0) -> DataFrame:
    """dt, part, end_offset, committed in rows for the file source of a stream, running or stopped: all rows of its folder and those read."""
    files = spark.read.format(format).option("recursiveFileLookup", True).load(path).groupBy(_plain(F.col("_metadata.file_path")).alias("path")).agg(F.count("*").alias("n"))
    done = read_files(spark, checkpoint, source).withColumn("_read", F.lit(True))
    one = files.join(done, "path", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("end_offset"), F.coalesce(F.sum(F.when(F.col("_read"), F.col("n"))), F.lit(0)).alias("committed"))
    return one.select(F.lit(day).alias("dt"), F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("part"), "end_offset", "committed")
