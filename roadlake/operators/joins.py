"""Joins: current dimension versions, change detection, salting for hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_current(fact: DataFrame, dim: DataFrame, key: str, dt: str | None = None, default: dict[str, str] | None = None) -> DataFrame:
    """Fact rows with the current version of their dimension row.

    Filters is_current and dt where the dimension has them. default: column values for unmatched keys, which stay;
    without it they go. Spark broadcasts the dimension where its size allows.
    """
    if "is_current" in dim.columns:
        dim = dim.filter("is_current = 'Y'").drop("is_current")
    if dt is not None and "dt" in dim.columns:
        dim = dim.filter(F.col("dt") == dt).drop("dt")
    out = fact.join(dim, key, "inner" if default is None else "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (default or {}).items()})


def differs(a: str, b: str, columns: list[str]) -> Column:
    """True where any column differs, nulls compared as values."""
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def changed(prev: DataFrame, src: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """Source rows that are new or differ in a tracked column."""
    a, b = src.alias("a"), prev.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").filter(F.col(f"b.{key}").isNull() | differs("a", "b", tracked)).select("a.*")


def unseen(src: DataFrame, prev: DataFrame, key: str) -> DataFrame:
    return src.join(prev.select(key), key, "left_anti")


def salted_join(left: DataFrame, right: DataFrame, key: str, hot_keys: list, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join with the rows of named hot keys spread over salts; only the right rows of these keys are repeated.

    how: inner, left, left_semi or left_anti; a join that keeps unmatched right rows would repeat them.
    """
    if how not in ("inner", "left", "left_outer", "leftouter", "left_semi", "leftsemi", "semi", "left_anti", "leftanti", "anti"):
        raise ValueError(f"a salted join cannot be {how}")
    spread = F.when(F.col(key).isin(hot_keys), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col(key).isin(hot_keys), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    out = left.withColumn("_salt", spread).join(right.withColumn("_salt", F.explode(copies)), [key, "_salt"], how)
    return out.drop("_salt")


def found_hot_keys(df: DataFrame, key: str, share: float = 0.01, tracked: int = 10_000) -> list:
    """The keys that hold over `share` of the rows, and perhaps some that nearly do, by a sketch of `tracked` keys a task.

    Sketches have one size whatever the rows and are merged. A sketch knows a key's rows to within 3.5 / tracked of all, so
    a key with twice that share of the rows or more is never missed (`share` is at least that); at most 2 / share keys come back.
    """
    if share < 7 / tracked:
        raise ValueError(f"a sketch of {tracked} keys finds shares of {7 / tracked} and more")
    rows = df.filter(F.col(key).isNotNull())
    found = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {min(tracked // 2, round(2 / share))}, {tracked})").alias("top")).first()
    return [r["item"] for r in found["top"] or [] if r["count"] >= (share - 3.5 / tracked) * found["n"]]


def balanced_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.01, salts: int = 16, how: str = "inner") -> DataFrame:
    """salted_join with the hot keys of the left side as a sketch finds them."""
    return salted_join(left, right, key, found_hot_keys(left, key, share), salts, how)
