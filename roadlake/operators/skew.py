"""Key frequencies: spread, concentration, hot keys, salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import percent


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def key_stats(df: DataFrame, key: str) -> DataFrame:
    """One row: keys, total, max, min, avg, stdev, cv and skew_ratio (max over mean) of the rows per key."""
    one = key_counts(df, key).agg(F.count("*").alias("keys"), F.sum("n").cast("long").alias("total"), F.max("n").alias("max"),
        F.min("n").alias("min"), F.avg("n").alias("avg"), F.stddev_samp("n").alias("stdev"))
    return one.withColumn("cv", F.col("stdev") / F.col("avg")).withColumn("skew_ratio", F.col("max") / F.col("avg"))


def gini(df: DataFrame, key: str) -> DataFrame:
    """Gini coefficient of the rows per key, normalised by n / (n - 1).

    Keys of one count are one row here, so the ordered pass is over different counts, of which there are at most
    about the square root of twice the rows.
    """
    held = key_counts(df, key).groupBy("n").agg(F.count("*").alias("k"))
    before = W.orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    ranked = held.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    # The ranks before + 1 to before + k have the same n; their sum is k * before + k * (k + 1) / 2.
    parts = ranked.agg(F.sum(F.col("n") * (F.col("k") * F.col("before") * 2 + F.col("k") * (F.col("k") + 1))).cast("double").alias("twice"),
        F.sum(F.col("n") * F.col("k")).cast("double").alias("total"), F.sum("k").cast("double").alias("keys"))
    raw = F.col("twice") / (F.col("keys") * F.col("total")) - (F.col("keys") + 1) / F.col("keys")
    return parts.select(F.when(F.col("keys") > 1, raw * F.col("keys") / (F.col("keys") - 1)).otherwise(F.lit(0.0)).alias("gini"))


def concentration(df: DataFrame, key: str, n: int) -> DataFrame:
    """Share (per cent) of the n most frequent keys."""
    counts = key_counts(df, key)
    top = counts.orderBy(F.desc("n"), key).limit(n).agg(F.sum("n").alias("top"))
    return top.crossJoin(counts.agg(F.sum("n").alias("total"))).select(percent(F.col("top"), F.col("total")).alias("share"))


def hot_keys(df: DataFrame, key: str, factor: float = 2) -> DataFrame:
    counts = key_counts(df, key)
    mean = counts.agg((F.avg("n") * factor).alias("_limit"))
    return counts.crossJoin(F.broadcast(mean)).filter("n > _limit").drop("_limit")


def salted_agg(df: DataFrame, keys: list[str], sums: dict[str, Column], salts: int = 10) -> DataFrame:
    """Sums in two stages: per salt and key, then per key; the salt is a hash of the row, so a retry gives the same."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).alias("_salt")
    first = df.groupBy(salt, *keys).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    return first.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])


def reduction(df: DataFrame, keys: list[str], salts: int = 10, salt: Column | None = None) -> DataFrame:
    """Rows before and after the first of the two stages, and the per cent saved; salt: by default a hash of the row."""
    salt = (F.xxhash64(*df.columns) if salt is None else salt) % salts
    one = df.groupBy(salt.alias("_salt"), *keys).agg(F.count("*").alias("n"))
    one = one.agg(F.sum("n").cast("long").alias("rows_before"), F.count("*").alias("rows_after"))
    return one.withColumn("saved_pct", 100.0 - percent(F.col("rows_after"), F.col("rows_before")))
