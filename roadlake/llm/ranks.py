"""Ranks within groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import width


def ranked(df: DataFrame, group: str, order: list[str], buckets: int | None = None) -> DataFrame:
    """Adds `_rank` (0-based within `group`, some fixed order) and `_size` (rows of the group).

    For groups of which there are few (the group table is broadcast). A group is dealt by a hash of `order` into as
    many parts as its share of all rows asks for; only the counts of parts are summed in order.
    """
    buckets = buckets or 16 * width(df.sparkSession)
    counts = df.groupBy(group).agg(F.count("*").alias("_size"))
    total = df.agg(F.count("*").alias("_all"))
    parts = F.broadcast(counts.crossJoin(F.broadcast(total)).select(group, "_size", F.ceil(F.col("_size") * buckets / F.col("_all")).cast("int").alias("_parts")))
    dealt = df.join(parts, group).withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts")).cast("int")).drop("_parts")
    starts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    starts = starts.select(group, "_part", (F.sum("_n").over(W.partitionBy(group).orderBy("_part")) - F.col("_n")).alias("_start"))
    own = W.partitionBy(group, "_part").orderBy(*order)
    return dealt.join(F.broadcast(starts), [group, "_part"]).withColumn("_rank", F.col("_start") + F.row_number().over(own) - 1).drop("_part", "_start")
