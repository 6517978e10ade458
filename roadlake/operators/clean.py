"""Cleaning and reshaping steps of the detail layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dedup(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row a key: the first by `order`, default all other columns ascending, nulls first."""
    order = order or [c for c in df.columns if c not in keys]
    first = W.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def clean(df: DataFrame, exprs: dict[str, Column], where: Column, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Filter, keep the first row of each key, project."""
    return dedup(df.filter(where), keys, order).select(*[c.alias(n) for n, c in exprs.items()])


def aggregate(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def merge_repeats(df: DataFrame, keys: list[str | Column], ts: str, seconds: int, aggs: dict[str, Column]) -> DataFrame:
    """Rows of a key within one fixed bucket of `seconds` become one."""
    bucket = F.floor(F.unix_timestamp(ts) / seconds).cast("long").alias("bucket")
    return df.groupBy(*keys, bucket).agg(*[c.alias(n) for n, c in aggs.items()])


def argmax(df: DataFrame, keys: list[str], value: str, by: str, tie: str) -> DataFrame:
    """value at the greatest `by`; of equals the one of least `tie`."""
    best = F.max(F.struct(F.col(by).alias("_by"), (-F.col(tie)).alias("_tie"), F.col(value).alias("_v")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b._v").alias(value), F.col("_b._by").alias(by))


def sampled(df: DataFrame, key: str, percent: int) -> DataFrame:
    """About `percent` per cent of the keys with all their rows, chosen by a hash of the key: the same ones in every run."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("long")
    return df.filter(number % 100 < percent)


def sets(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The different values of each group, in order, as text."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(value)), ",").alias(f"{value}s"), F.countDistinct(value).alias("n"))
