"""Isolation forest on Spark: sampled trees grown on executors, rows scored in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import count_where
from ..sources.shared import cut


def average_depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(rows: np.ndarray, seed: int) -> list[list[float]]:
    """A tree as rows (column, cut, left, right, depth): leaves have column -1 and their path length as cut."""
    rng, limit = np.random.default_rng(seed), int(np.ceil(np.log2(max(2, len(rows)))))
    nodes: list[list[float]] = []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([])
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) else []
        if depth >= limit or len(part) <= 1 or not len(spread):
            nodes[at] = [-1, depth + average_depth(len(part)), -1, -1]
            return at
        column = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, column].min(), part[:, column].max()))
        low = part[:, column] < cut
        nodes[at] = [column, cut, add(part[low], depth + 1), add(part[~low], depth + 1)]
        return at

    add(rows, 0)
    return nodes


def path_lengths(nodes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    at = np.zeros(len(rows), np.int64)
    while True:
        column = nodes[at, 0].astype(np.int64)
        inner = column >= 0
        if not inner.any():
            return nodes[at, 1]
        low = rows[np.arange(len(rows)), np.maximum(column, 0)] < nodes[at, 1]
        at = np.where(inner, np.where(low, nodes[at, 2], nodes[at, 3]).astype(np.int64), at)


#: Scores are rounded to these decimals; scores that agree in them are equal.
PLACES, DIGITS = 12, 4


def score_at_rank(scored: DataFrame, k: int, score: str = "score") -> float | None:
    """The k-th greatest score, exactly: DIGITS decimals a round, each from at most 10**DIGITS + 1 counts."""
    rows = scored.filter(F.col(score).isNotNull()).select(F.round(F.col(score) * 10.0**PLACES).cast("long").alias("code"))
    head = 0
    for level in range(PLACES // DIGITS - 1, -1, -1):
        step = 10 ** (DIGITS * level)
        part = F.expr(f"code div {step}")
        counts = rows.filter(F.expr(f"code div {step * 10**DIGITS}") == head).groupBy(part.alias("part")) if level < PLACES // DIGITS - 1 else rows.groupBy(part.alias("part"))
        counts = counts.agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy(F.desc("part"))))
        found = counts.filter(F.col("upto") >= k).orderBy(F.desc("part")).select("part", F.col("upto") - F.col("n")).first()
        if found is None:
            return None
        head, k = found[0], k - found[1]
    return head / 10.0**PLACES


class IForest:
    """n trees on samples of at most `sample` rows; rows whose score is over the k-th greatest are anomalies.

    k = floor(n_rows * contamination), one at least. Rows with a null feature are neither sampled nor scored (score
    null). Scores have PLACES decimals. A row's place in a sample is a hash of its columns `key` (default: the
    features), so a retry or another layout of the input gives the same trees.
    """

    def __init__(self, n: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42):
        self.n, self.sample, self.contamination, self.seed = n, sample, contamination, seed

    def fit(self, df: DataFrame, columns: list[str], key: list[str] | None = None) -> IForest:
        """One law at every size: each tree draws each row with the same probability, some 4 * sample rows a tree, and keeps `sample` of them.

        Equal rows are counted first: of m of them a tree draws m times that probability, rounded up or down by a hash of
        the row and the tree. A row's first tree is found by one hash (it is geometric), so rows that no tree draws cost no more.
        """
        id_ = F.xxhash64(F.lit(self.seed), *(key or columns))
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], id_.alias("_id")).dropna()
        rows = cut(rows.groupBy(*columns, "_id").agg(F.count("*").alias("_m")))
        total = rows.agg(F.sum("_m")).first()[0] or 0
        self.columns, n = columns, self.n
        unit = lambda h: F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
        shares = rows.withColumn("_q", F.col("_m") * min(1.0, 4.0 * self.sample / max(1, total))).withColumn("_whole", F.floor("_q"))
        shares = shares.withColumn("_part", F.col("_q") - F.col("_whole"))
        first = F.floor(F.log(1.0 - unit(F.col("_id"))) / F.log(1.0 - F.col("_part"))).cast("int")
        later = F.filter(F.sequence(F.col("_first") + 1, F.lit(n)), lambda t: (t < n) & (unit(F.xxhash64("_id", t)) < F.col("_part")))
        some = shares.filter("_part > 0").withColumn("_first", F.least(first, F.lit(n))).filter(F.col("_first") < n)
        some = some.select(*columns, "_id", F.col("_whole").alias("_i"), F.explode(F.concat(F.array("_first"), later)).alias("t"))
        every = shares.filter("_whole > 0").select(*columns, "_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole") - 1)).alias("_i"))
        every = every.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        drawn = some.unionByName(every).select(*columns, "t", F.xxhash64("_id", "_i", "t").alias("u"))

        size, seed = self.sample, self.seed

        def tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf.sort_values(["u", *columns]).head(size)[columns].to_numpy(float)
            return pd.DataFrame({"t": [key[0]], "nodes": [json.dumps(grow(own, seed * 1000003 + int(key[0])))], "rows": [len(own)]})

        # A tree's group has about 4 * sample rows, whatever the input; so many trees of so many nodes reach the driver.
        grown = drawn.groupBy("t").applyInPandas(tree, "t int, nodes string, rows long").collect()
        self.trees = [np.array(json.loads(g["nodes"])) for g in sorted(grown, key=lambda g: g["t"])]
        self.size = max([2, *(g["rows"] for g in grown)])
        return self

    def score(self, df: DataFrame) -> DataFrame:
        shared, norm = df.sparkSession.sparkContext.broadcast(self.trees), average_depth(self.size)

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in batches:
                rows = np.column_stack([c.to_numpy(float) for c in cols])
                mean = sum(path_lengths(t, rows) for t in shared.value) / max(1, len(shared.value))
                out = np.round(2.0 ** (-mean / norm), PLACES)
                yield pd.Series(np.where(np.isnan(rows).any(axis=1), np.nan, out))

        scored = cut(df.withColumn("score", F.nanvl(run(*[F.col(c).cast("double") for c in self.columns]), F.lit(None).cast("double"))))
        total = scored.filter("score is not null").count()
        limit = score_at_rank(scored, max(1, int(total * self.contamination)))
        return scored.withColumn("is_anomaly", F.coalesce(F.col("score") > F.lit(limit), F.lit(False)))


    @classmethod
    def of(cls, trees: list[np.ndarray], size: int, columns: list[str], contamination: float = 0.05) -> IForest:
        """A forest of given trees (rows as `grow` makes them) that were grown on samples of `size` rows."""
        out = cls(len(trees), size, contamination)
        out.trees, out.size, out.columns = trees, size, columns
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """t, node, col, cut, low, high: the trees as rows, n times about 2 * sample of them; leaves have col -1 and their path length as cut."""
        rows = [(t, i, int(c), float(cut), int(low), int(high)) for t, nodes in enumerate(self.trees) for i, (c, cut, low, high) in enumerate(nodes.tolist())]
        return spark.createDataFrame(rows, "t int, node int, col int, cut double, low int, high int")

    def score_by_joins(self, df: DataFrame, places: int = 6) -> DataFrame:
        """What `score` gives, to `places` decimals, by joins with the table of trees: a step down in each, all rows and trees at once.

        Path lengths are summed as decimals of `places`, so the result does not depend on their order and SQL can repeat it.
        """
        trees = F.broadcast(self.table(df.sparkSession))
        depth = max(_depth(t) for t in self.trees)
        rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
        features = rows.select("_row", F.array(*[F.col(c).cast("double") for c in self.columns]).alias("_x"))
        at = features.filter(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))
        at = at.select("_row", "_x", F.explode(F.sequence(F.lit(0), F.lit(len(self.trees) - 1))).alias("t"), F.lit(0).alias("node"))
        for _ in range(depth):
            inner = F.col("col") >= 0
            goes = F.when(F.get("_x", F.greatest("col", F.lit(0))) < F.col("cut"), F.col("low")).otherwise(F.col("high"))
            at = at.join(trees, ["t", "node"]).select("_row", "_x", "t", F.when(inner, goes).otherwise(F.col("node")).alias("node"))
        paths = at.join(trees, ["t", "node"]).groupBy("_row").agg(F.sum(F.round("cut", places).cast(f"decimal(18,{places})")).cast("double").alias("_sum"))
        score = F.round(F.pow(F.lit(2.0), -(F.col("_sum") / F.lit(float(len(self.trees)))) / F.lit(float(average_depth(self.size)))), places)
        scored = cut(rows.join(paths.select("_row", score.alias("score")), "_row", "left").drop("_row"))
        limit = score_at_rank(scored, max(1, int(scored.filter("score is not null").count() * self.contamination)))
        return scored.withColumn("is_anomaly", F.coalesce(F.col("score") > F.lit(limit), F.lit(False)))


def _depth(nodes: np.ndarray, at: int = 0) -> int:
    return 0 if nodes[at, 0] < 0 else 1 + max(_depth(nodes, int(nodes[at, 2])), _depth(nodes, int(nodes[at, 3])))


def flow_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"morning": F.col("hour").between(7, 9).cast("int"), "evening": F.col("hour").between(17, 19).cast("int")})


def flow_anomaly(df: DataFrame, trees: int = 100, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Features flow, hour, morning and evening flag; under 24 rows nothing is an anomaly."""
    rows = flow_features(df)
    if rows.limit(24).count() < 24:
        return rows.withColumns({"score": F.lit(None).cast("double"), "is_anomaly": F.lit(False)})
    return IForest(trees, contamination=contamination, seed=seed).fit(rows, ["flow", "hour", "morning", "evening"]).score(rows)


def device_anomaly(df: DataFrame, trees: int = 100, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Features cpu, mem, temp; cause of an anomaly in the order temp over 80, cpu over 90, mem over 90."""
    if df.limit(10).count() < 10:
        out = df.withColumns({"score": F.lit(None).cast("double"), "is_anomaly": F.lit(False)})
    else:
        out = IForest(trees, contamination=contamination, seed=seed).fit(df, ["cpu", "mem", "temp"]).score(df)
    return with_cause(out)


def with_cause(scored: DataFrame) -> DataFrame:
    cause = F.when(F.col("temp") > 80, "TEMP_HIGH").when(F.col("cpu") > 90, "CPU_HIGH").when(F.col("mem") > 90, "MEMORY_HIGH").otherwise("COMBINED")
    return scored.withColumn("cause", F.when(F.col("is_anomaly"), cause))


def summary(df: DataFrame) -> DataFrame:
    one = df.agg(F.count("*").alias("total"), count_where(F.col("is_anomaly")).alias("anomalies"))
    return one.withColumn("level", F.when(F.col("anomalies") == 0, "NORMAL").when(F.col("anomalies") < 5, "WARNING").otherwise("CRITICAL"))
