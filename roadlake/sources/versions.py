"""Table versions behind a committed pointer: readers see one whole version, during any rewrite and after any failure.

A version is a folder `<path>/v=<name>`. The log `<path>/_log` has a file for each commit, numbered from 1, that names the
version's folder; a file is made by exclusive creation, so of two writers that start from one version one fails and the
table is as the other made it. The current version is that of the greatest number whose file is whole. Nothing is renamed or
removed before the commit; versions but the last KEEP go after it, so a reader that resolved the one before can go on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

KEEP = 2


class Conflict(Exception):
    """Another writer has committed since the version that this one started from."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the whole commits in order."""
    fs, log = _fs(spark, f"{path}/_log")
    names = sorted(s.getPath().getName() for s in fs.listStatus(log)) if fs.exists(log) else []
    out = []
    for name in names:
        if name.isdigit():
            _, p = _fs(spark, f"{path}/_log/{name}")
            stream = fs.open(p)
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                out.append((int(name), text.strip()))
    return out


def _last(spark: SparkSession, path: str) -> int:
    """Number of the last commit, whole or not."""
    fs, log = _fs(spark, f"{path}/_log")
    return max([int(s.getPath().getName()) for s in fs.listStatus(log) if s.getPath().getName().isdigit()], default=0) if fs.exists(log) else 0


def commit(spark: SparkSession, path: str, folder: str, number: int) -> None:
    fs, p = _fs(spark, f"{path}/_log/{number:012d}")
    if fs.exists(p):
        raise Conflict(f"{path} has a commit {number}")
    try:
        out = fs.create(p, False)
    except Exception as e:
        raise Conflict(f"{path} has a commit {number}") from e
    out.write(bytearray(f"{folder}\n".encode()))
    out.close()


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version; None before the first."""
    found = _commits(spark, path)
    return f"{path}/{found[-1][1]}" if found else None


def read_current(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    folder = current(spark, path)
    if folder is None:
        raise ValueError(f"{path} has no version yet")
    return spark.read.format(format).load(folder)


def publish(spark: SparkSession, rows: DataFrame, path: str, format: str = "parquet", by: list[str] | None = None, after: int | None = None) -> str:
    """Writes rows as the next version and commits it; after: the commit that rows were read from (default: the last one now)."""
    number = (_last(spark, path) if after is None else after) + 1
    folder = f"v={uuid.uuid4().hex}"
    writer = rows.write.format(format)
    (writer.partitionBy(*by) if by else writer).save(f"{path}/{folder}")
    try:
        commit(spark, path, folder, number)
    except Conflict:
        fs, p = _fs(spark, f"{path}/{folder}")
        fs.delete(p, True)
        raise
    drop_versions(spark, path)
    return f"{path}/{folder}"


def drop_versions(spark: SparkSession, path: str, keep: int = KEEP) -> None:
    """Removes the versions of all commits but the last `keep`, and then their log files but for those of the kept ones."""
    done = _commits(spark, path)
    kept = {folder for _, folder in done[-keep:]}
    for number, folder in done[:-keep]:
        if folder not in kept:
            fs, p = _fs(spark, f"{path}/{folder}")
            fs.delete(p, True)
        fs, p = _fs(spark, f"{path}/_log/{number:012d}")
        fs.delete(p, False)


def compact_current(spark: SparkSession, path: str, files: int, format: str = "parquet", by: list[str] | None = None) -> str:
    """The current version in `files` files (or tasks, with partition columns `by`), as a new version."""
    start = _last(spark, path)
    rows = read_current(spark, path, format)
    return publish(spark, rows.repartition(files, *by) if by else rows.repartition(files), path, format, by, start)
