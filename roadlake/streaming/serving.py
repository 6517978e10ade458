"""Serving tables kept by streams: the newest row of each key in buckets, and a recent list of fixed length.

A latest-value table of `path` is data and a log. A batch reduces its rows to the newest of each key and writes them, by
bucket of the key, to `<path>_data/batch=<id>/bucket=<b>`; then it writes the list of live folders of each bucket to
`<path>/version=<id>`, which makes the batch visible. Readers take the newest finished list and the newest row of each key
in its folders (merge on read). A bucket with over MOST_FOLDERS folders is merged into one by the batch that meets it, so a
batch of few keys reads and writes the buckets of these keys only. A repeated batch starts from the list before it and
writes the same folders again; folders that the last two lists do not name are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete

BUCKETS, MOST_FOLDERS = 64, 8


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders in `path` that begin with prefix, by the file system that holds it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return [n for n in (s.getPath().getName() for s in fs.listStatus(hadoop)) if n.startswith(prefix)] if fs.exists(hadoop) else []


def finished(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished snapshots."""
    return [int(n.split("=")[1]) for n in _children(spark, path, "version=") if finished(spark, f"{path}/{n}")]


def latest_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """Greatest finished snapshot, before `below` if given."""
    return max([v for v in versions(spark, path) if below is None or v < below], default=None)


def drop_versions(spark: SparkSession, path: str, newest_id: int, keep: int = 2) -> None:
    """Removes snapshots but the last `keep` up to newest_id: a reader of the one before may still be at work."""
    done = sorted(v for v in versions(spark, path) if v <= newest_id)
    for v in done[:-keep]:
        delete(spark, f"{path}/version={v}")


def newest(rows: DataFrame, keys: str | list[str], order: str | list[str]) -> DataFrame:
    """The row of each key that is last by `order`; of equal ones the one of greatest hash, so any order of merging gives the same."""
    keys, order = [keys] if isinstance(keys, str) else keys, [order] if isinstance(order, str) else order
    last = F.struct(*order, F.xxhash64(*rows.columns))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), last).alias("r")).select("r.*")


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _listed(spark: SparkSession, path: str, version: int | None) -> list[tuple[int, str]]:
    """(bucket, folder) of a list: at most MOST_FOLDERS + 1 a bucket."""
    return [] if version is None else [(r["bucket"], r["folder"]) for r in spark.read.parquet(f"{path}/version={version}").collect()]


def _rows_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.parquet(*folders)


def upsert_latest(path: str, key: str | list[str], ts: str | list[str], buckets: int = BUCKETS, most_folders: int = MOST_FOLDERS) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each key."""
    keys = [key] if isinstance(key, str) else key

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, data = batch.sparkSession, f"{path}_data"

        def written(rows: DataFrame, name: str) -> dict[int, str]:
            """Writes the newest rows by bucket to a folder of the batch; the buckets that it holds."""
            rows.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{data}/{name}")
            return {int(n.split("=")[1]): f"{data}/{name}/{n}" for n in _children(spark, f"{data}/{name}", "bucket=")}

        live: dict[int, list[str]] = {}
        for b, folder in _listed(spark, path, latest_version(spark, path, batch_id)):
            live.setdefault(b, []).append(folder)
        touched = written(newest(batch, keys, ts), f"batch={batch_id}")
        for b, folder in touched.items():
            live.setdefault(b, []).append(folder)
        full = [b for b in touched if len(live[b]) > most_folders]
        if full:
            merged = written(newest(_rows_of(spark, [f for b in full for f in live[b]]), keys, ts), f"merged={batch_id}")
            live |= {b: [merged[b]] for b in full}
        rows = [(b, f) for b, folders in sorted(live.items()) for f in folders]
        spark.createDataFrame(rows, "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        drop_versions(spark, path, batch_id)
        _drop_folders(spark, path)

    return sink


def _drop_folders(spark: SparkSession, path: str) -> None:
    """Removes the folders of batches, and of their buckets, that no remaining list names."""
    data, known = f"{path}_data", {f for v in versions(spark, path) for _, f in _listed(spark, path, v)}
    for name in _children(spark, data, "batch=") + _children(spark, data, "merged="):
        held = [f"{data}/{name}/{b}" for b in _children(spark, f"{data}/{name}", "bucket=")]
        if not any(f in known for f in held):
            delete(spark, f"{data}/{name}")
        else:
            for f in held:
                if f not in known:
                    delete(spark, f)


def read_table(spark: SparkSession, path: str, key: str | list[str], ts: str | list[str], version: int | None = None) -> DataFrame | None:
    """The newest row of each key; None for a table without batches or rows."""
    folders = [f for _, f in _listed(spark, path, latest_version(spark, path) if version is None else version)]
    return newest(_rows_of(spark, folders), key, ts) if folders else None


def read_latest(spark: SparkSession, path: str, ttl_s: int, as_of: str, ts: str = "update_time", key: str | list[str] = "road_id") -> DataFrame:
    """The newest rows that were updated within ttl_s seconds before as_of."""
    rows = read_table(spark, path, key, ts)
    if rows is None:
        raise ValueError(f"{path} has no rows yet")
    return rows.filter(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts) < ttl_s)


def recent(df: DataFrame, n: int = 100, ts: str = "ts") -> DataFrame:
    """The newest n rows; of one time in the order of the other columns."""
    return df.orderBy(F.desc(ts), *[c for c in df.columns if c != ts]).limit(n)


def keep_recent(path: str, n: int = 100, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest n rows of all batches, one snapshot of n rows at most for each batch.

    The newest n of a list and of more rows are the newest n of the newest n of either, so nothing else need be kept.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = latest_version(spark, path, batch_id)
        rows = recent(batch, n, ts)
        if old is not None:
            rows = recent(rows.unionByName(spark.read.parquet(f"{path}/version={old}")), n, ts)
        rows.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        drop_versions(spark, path, batch_id)

    return sink


def read_recent(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    rows = spark.read.parquet(f"{path}/version={latest_version(spark, path)}")
    return rows.orderBy(F.desc(ts), *[c for c in rows.columns if c != ts])
