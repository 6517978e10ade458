"""Lineage: closure over an edge table (src, dst) of any size and depth, safe against cycles.

A walk goes on from its newest tables only: each round joins them with the edges
a few hops on and drops what was seen before, so a table is expanded once however
many paths lead to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Hops of the first round and of the longest ones; each round doubles them.
HOPS, MOST_HOPS = 4, 16


def _edges(edges: DataFrame, at: str, to: str) -> DataFrame:
    rows = edges.filter("src is not null and dst is not null")
    return rows.select(F.col(at).alias("_at"), F.col(to).alias("_to")).distinct()


def _closure(edges: DataFrame, start: str, at: str, to: str, max_depth: int | None) -> DataFrame:
    """Tables reached from `start` with their least depth (the start itself only by a cycle)."""
    steps = cut(_edges(edges, at, to))
    newest = steps.filter(F.col("_at") == start).select(F.col("_to").alias("table_name"))
    seen, depth, hops = None, 1, HOPS
    while max_depth is None or depth <= max_depth:
        hops = hops if max_depth is None else min(hops, max_depth - depth + 1)
        levels = [newest]
        for _ in range(hops - 1):
            levels.append(levels[-1].join(steps, F.col("table_name") == F.col("_at")).select(F.col("_to").alias("table_name")).distinct())
        found = reduce(DataFrame.union, [rows.withColumn("depth", F.lit(depth + i)) for i, rows in enumerate(levels)])
        found = found.groupBy("table_name").agg(F.min("depth").alias("depth"))
        if seen is not None:
            found = found.join(seen, "table_name", "left_anti")
        seen = cut(found if seen is None else seen.unionByName(found))
        depth += hops
        last = seen.filter(F.col("depth") == depth - 1)
        if not last.limit(1).count():
            break
        newest = last.join(steps, F.col("table_name") == F.col("_at")).select(F.col("_to").alias("table_name")).distinct()
        hops = min(2 * hops, MOST_HOPS)
    return seen


def downstream(edges: DataFrame, table: str, max_depth: int | None = None) -> DataFrame:
    return _closure(edges, table, "src", "dst", max_depth)


def upstream(edges: DataFrame, table: str, max_depth: int | None = None) -> DataFrame:
    return _closure(edges, table, "dst", "src", max_depth)


def impact(edges: DataFrame, table: str, max_depth: int | None = None) -> DataFrame:
    kind = F.when(F.col("depth") == 1, "DIRECT").otherwise("INDIRECT")
    return downstream(edges, table, max_depth).withColumn("type", kind)


def trace(edges: DataFrame, table: str, column: str) -> DataFrame:
    """root, path, column: every path from the table up to a table without a source, each table once on a path."""
    steps = cut(_edges(edges, "dst", "src"))
    walks = steps.sparkSession.range(1).select(F.lit(table).alias("node"), F.array(F.lit(table)).alias("path"))
    roots = []
    while True:
        walks = cut(walks)
        roots.append(walks.join(steps, F.col("node") == F.col("_at"), "left_anti"))
        on = walks.join(steps, F.col("node") == F.col("_at")).filter(~F.array_contains("path", F.col("_to")))
        walks = on.select(F.col("_to").alias("node"), F.array_append("path", F.col("_to")).alias("path"))
        if not walks.limit(1).count():
            break
    out = reduce(DataFrame.unionByName, roots)
    return out.select(F.col("node").alias("root"), F.array_join("path", " <- ").alias("path"), F.lit(column).alias("column"))


def layer_stats(edges: DataFrame) -> DataFrame:
    """Tables and edges of each layer, a layer being the name up to its first underscore."""
    nodes = edges.select(F.col("src").alias("t")).union(edges.select("dst")).distinct()
    tables = nodes.groupBy(F.substring_index("t", "_", 1).alias("layer")).agg(F.count("*").alias("tables"))
    incoming = edges.groupBy(F.substring_index("dst", "_", 1).alias("layer")).agg(F.count("*").alias("incoming"))
    return tables.join(incoming, "layer", "left").fillna(0, ["incoming"])
