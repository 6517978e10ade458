"""Ordered rows of a key: gaps, moving means, runs, bursts, spikes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import band, count_where, rounded
from ..sources.shared import cut


def blocks(ts: str, seconds: int = 86400) -> Column:
    """Number of the time block of a row: long histories of one key are dealt by it."""
    return F.floor(F.unix_timestamp(ts) / seconds).cast("long")


def block_of(df: DataFrame, order: str) -> Column:
    """A number that does not fall along `order` and by which a key's rows can be dealt: days of times, thousands of numbers."""
    kind = dict(df.dtypes)[order]
    if kind.startswith(("timestamp", "date")):
        return blocks(order)
    if kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        return F.floor(F.col(order) / 1000).cast("long")
    raise ValueError(f"{order} is neither a time nor a number: name the blocks")


def ranked(df: DataFrame, keys: list[str], order: list[Column], block: Column, rank: str) -> DataFrame:
    """Adds `rank`, from 0 within the keys by block and then `order`: counts of blocks are summed, rows are ordered within blocks only."""
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    # One row a block.
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy(F.col("_block").asc_nulls_first())) - F.col("_n")
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_at"), before.alias("_before"))
    same = F.col("_block").eqNullSafe(F.col("_at"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(*order))
    rows = rows.withColumn("_own", own).join(counts, same)
    return rows.withColumn(rank, F.col("_before") + F.col("_own") - 1).select(*df.columns, rank)


def moving_avg(df: DataFrame, keys: list[str], ts: str, col: str, rows: int = 5, name: str = "moving_avg", block: Column | None = None, size: int = 4096) -> DataFrame:
    """The mean of the row and the rows - 1 before it, in the order of `ts` (rows of one time by a hash of the row).

    Rows are numbered within their keys and dealt in blocks of `size` numbers; the last rows - 1 of a block go to the
    next one too, so a window never needs more than one block and a long history is several tasks' work.
    """
    size = max(size, rows)
    tie = F.xxhash64(*df.columns)
    numbered = ranked(df, keys, [F.col(ts).asc_nulls_first(), tie], block_of(df, ts) if block is None else block, "_rank")
    part = F.floor(F.col("_rank") / size).cast("long")
    # The block of the row, and the next one for the rows that windows there reach back to.
    parts = F.array_distinct(F.array(part, F.floor((F.col("_rank") + rows - 1) / size).cast("long")))
    dealt = numbered.withColumn("_home", part).withColumn("_part", F.explode(parts))
    own = W.partitionBy(*keys, "_part").orderBy("_rank").rowsBetween(1 - rows, 0)
    out = dealt.withColumn(name, rounded(F.sum(col).over(own).cast("double") / F.count(col).over(own)))
    return out.filter("_part = _home").select(*df.columns, name)


def gaps(df: DataFrame, key: str, ts: str, max_minutes: float = 30) -> DataFrame:
    """Pauses of over max_minutes between a key's neighbouring rows; HIGH over twice that.

    Rows are dealt by key and day; the first of a day looks back to the last time of the key's day before.
    """
    rows = df.select(key, F.col(ts).alias("gap_end"), blocks(ts).alias("_block"))
    ends = rows.groupBy(key, "_block").agg(F.max("gap_end").alias("_end"))
    ends = ends.select(key, "_block", F.lag("_end").over(W.partitionBy(key).orderBy("_block")).alias("_end"))
    # Null keys are a group of their own, so the join takes them as equal.
    ends = ends.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), "_end")
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")))
    before = F.lag("gap_end").over(W.partitionBy(key, "_block").orderBy("gap_end"))
    rows = rows.select(key, F.coalesce(before, "_end").alias("gap_start"), "gap_end").filter("gap_start is not null")
    rows = rows.withColumn("gap_minutes", (F.unix_timestamp("gap_end") - F.unix_timestamp("gap_start")) / 60.0).filter(F.col("gap_minutes") > max_minutes)
    return rows.withColumn("severity", F.when(F.col("gap_minutes") > 2 * max_minutes, "HIGH").otherwise("MEDIUM"))


def sequence(df: DataFrame, key: str, ts: str, cond: Column, n: int, within: int, first_only: bool = False) -> DataFrame:
    """n rows in a row that meet `cond`, the last less than `within` seconds after the first.

    Matches may overlap; first_only keeps a key's first. Rows of one time are ordered by all their columns; rows without
    a time match nothing. Rows are dealt by key and block of time; those less than `within` seconds before the next
    block go to it too, since a match that ends there may begin with them.
    """
    width = max(86400, within)
    at = F.unix_timestamp(ts)
    rows = df.filter(F.col(ts).isNotNull()).select(
        key, F.col(ts).alias("last_ts"), F.xxhash64(*df.columns).alias("_tie"), F.coalesce(cond, F.lit(False)).cast("int").alias("_ok"),
        blocks(ts, width).alias("_own"), F.floor((at + within) / width).cast("long").alias("_next"))
    rows = rows.withColumn("_block", F.explode(F.array_distinct(F.array("_own", "_next"))))
    own = W.partitionBy(key, "_block").orderBy("last_ts", "_tie")
    rows = rows.select(
        key, "last_ts", F.lag("last_ts", n - 1).over(own).alias("first_ts"), F.sum("_ok").over(own.rowsBetween(1 - n, 0)).alias("_run"), "_own",
            "_block")
    found = rows.filter((F.col("_own") == F.col("_block")) & (F.col("_run") == n) & (F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts") < within))
    found = found.select(key, "first_ts", "last_ts")
    return found.groupBy(key).agg(F.min(F.struct("last_ts", "first_ts")).alias("m")).select(key, "m.first_ts", "m.last_ts") if first_only else found


def burst(df: DataFrame, key: str, ts: str, window: str, more_than: int, level: str = "CRITICAL") -> DataFrame:
    """Fixed windows with over more_than rows of a key."""
    rows = df.groupBy(key, F.window(ts, window).alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)
    return rows.select(key, F.col("w.start").alias("window_start"), "n", F.lit(level).alias("level"))


def frequent(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Keys with over ten rows in five minutes (CRITICAL) and with five or more in a day (WARNING)."""
    return burst(df, key, ts, "5 minutes", 10).unionByName(burst(df, key, ts, "1 day", 4, "WARNING"))


def sustained(df: DataFrame, key: str, ts: str, cond: Column, minutes: tuple[float, float] = (30, 60)) -> DataFrame:
    """Unbroken stretches of rows that meet `cond` for over minutes[0]; CRITICAL over minutes[1].

    Rows are dealt by key and day. Stretches within a day are final; those that touch an end of a day, two a day at
    most, are joined to those of the key's next day with rows.
    """
    day = W.partitionBy(key, "_block")
    rows = df.filter(F.col(ts).isNotNull()).select(key, F.col(ts).alias("_ts"), F.coalesce(cond, F.lit(False)).alias("_ok"), blocks(ts).alias("_block"))
    breaks = F.sum(F.when(F.col("_ok"), 0).otherwise(1))
    rows = rows.withColumn("_part", breaks.over(day.orderBy("_ts").rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", breaks.over(day))
    runs = rows.groupBy(key, "_block", "_part", "_all").agg(
        F.min(F.when(F.col("_ok"), F.col("_ts"))).alias("start_ts"), F.max(F.when(F.col("_ok"), F.col("_ts"))).alias("end_ts"), count_where(F.col("_ok")).alias("n"))
    # A part without rows that meet the condition only says that the day was broken there.
    inner = runs.filter((F.col("_part") > 0) & (F.col("_part") < F.col("_all")) & (F.col("n") > 0))
    ends = runs.filter((F.col("_part") == 0) | (F.col("_part") == F.col("_all")))
    # Both ends of each day, the first one empty where the day begins with a break.
    held = ends.groupBy(key, "_block", "_all").agg(*[
        F.max(F.when(F.col("_part") == p, F.struct("start_ts", "end_ts", "n"))).alias(name) for name, p in (("first", F.lit(0)), ("last", F.col("_all")))])
    both = F.when(F.col("_all") == 0, F.array(F.struct(F.col("first").alias("run"), F.lit(False).alias("broken")))).otherwise(
        F.array(F.struct(F.col("first").alias("run"), F.lit(False).alias("broken")), F.struct(F.col("last").alias("run"), F.lit(True).alias("broken"))))
    ends = held.select(key, "_block", F.posexplode(both).alias("_side", "e"))
    chain = F.sum(F.when(F.col("e.broken"), 1).otherwise(0)).over(W.partitionBy(key).orderBy("_block", "_side").rowsBetween(W.unboundedPreceding, 0))
    joined = ends.withColumn("_chain", chain).filter("e.run.n > 0").groupBy(key, "_chain").agg(
        F.min("e.run.start_ts").alias("start_ts"), F.max("e.run.end_ts").alias("end_ts"), F.sum("e.run.n").cast("long").alias("n"))
    runs = inner.select(key, "start_ts", "end_ts", "n").unionByName(joined.select(key, "start_ts", "end_ts", "n"))
    runs = runs.withColumn("minutes", (F.unix_timestamp("end_ts") - F.unix_timestamp("start_ts")) / 60.0).filter(F.col("minutes") > minutes[0])
    return runs.withColumn("level", band(F.col("minutes"), [(minutes[1] + 1e-9, "CRITICAL")], "WARNING"))


def vs_history(df: DataFrame, key: str, day: str, hour: str, flow: str, days: int = 7, factor: float = 2, span: int = 28) -> DataFrame:
    """Rows whose flow is over factor times the mean of the same hour on the days before.

    Dealt by blocks of `span` days; the last `days` of a block go to the next one too, as its history.
    """
    span = max(span, days)
    at = F.datediff(F.col(day).cast("date"), F.lit("1970-01-01"))
    part = lambda d: F.floor(d / span).cast("long")
    rows = df.withColumn("_day", at).withColumn("_home", part(F.col("_day")))
    rows = rows.withColumn("_part", F.explode(F.array_distinct(F.array("_home", part(F.col("_day") + days)))))
    own = W.partitionBy(key, hour, "_part").orderBy("_day").rangeBetween(-days, -1)
    rows = rows.withColumn("history_avg", F.sum(flow).over(own).cast("double") / F.count(flow).over(own))
    rows = rows.filter((F.col("_part") == F.col("_home")) & (F.col(flow) > factor * F.col("history_avg")))
    return rows.drop("_day", "_home", "_part").withColumn("history_avg", rounded(F.col("history_avg"), 4))


def spike_step(state: tuple[float, int] | None, flow: float, alpha: float, factor: float, warmup: int) -> tuple[tuple[float, int], float | None]:
    """New state and, where the flow is a spike, the average it was held against."""
    if state is None:
        return (float(flow), 1), None
    average, seen = state
    hit = average if seen >= warmup and flow > factor * average else None
    return (alpha * flow + (1 - alpha) * average, seen + 1), hit


def flow_spike(df: DataFrame, key: str, order: str, flow: str, alpha: float = 0.2, factor: float = 2, warmup: int = 5,
    block: Column | None = None) -> DataFrame:
    """Rows over factor times the key's moving average of the rows before; the average then takes the row in.

    A block (default: a day of times, a thousand of numbers) is folded apart. What its rows do to the average is linear in
    the average that it starts with, so one pass gives each row the factor and the sum by which that average makes the one
    it is held against; the blocks of a key are then chained by these steps, one row each. No task holds a key or works
    through its whole history; a task's memory is one Arrow batch and one block's state.
    """
    rows = df.select(key, order, F.col(flow).cast("double").alias("flow"), (block_of(df, order) if block is None else block).alias("_block"))
    rows = rows.filter(F.col(key).isNotNull() & F.col("flow").isNotNull())
    kind, when, stay = dict(df.dtypes)[key], dict(df.dtypes)[order], 1 - alpha
    dealt = rows.select(key, "_block", order, "flow").repartition(key, "_block").sortWithinPartitions(key, "_block", order, "flow")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with how many of its block came before it and what they add to an average of 0 at the block's start."""
        last, n, add = None, 0, 0.0
        for batch in batches:
            own, at = batch.column(0), batch.column(1)
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = pc.or_(pc.not_equal(own[1:], own[:-1]), pc.not_equal(at[1:], at[:-1])).to_numpy(zero_copy_only=False)
            new[0] = (own[0].as_py(), at[0].as_py()) != last
            counts, added = [], []
            for begins, f in zip(new.tolist(), batch.column(3).to_pylist()):
                if begins:
                    n, add = 0, 0.0
                counts.append(n)
                added.append(add)
                n, add = n + 1, alpha * f + stay * add
            last = (own[-1].as_py(), at[-1].as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(added, pa.float64())], names=[*batch.schema.names, "n", "add"])

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The average and the number of rows that each block of a key starts with, from blocks in order."""
        last, mean, seen = None, 0.0, 0
        for pdf in batches:
            out = []
            for k, b, n, add, first in zip(pdf[key], pdf["_block"], pdf["n"], pdf["add"], pdf["first"]):
                if k != last:
                    # The first row is the first average: as if the key had started with it.
                    last, mean, seen = k, first, 0
                out.append((k, b, mean, seen))
                mean, seen = stay**n * mean + add, seen + n
            yield pd.DataFrame(out, columns=[key, "_block", "mean", "seen"])

    folded = cut(dealt.mapInArrow(sums, f"`{key}` {kind}, _block long, `{order}` {when}, flow double, n long, add double"))
    ends = folded.groupBy(key, "_block").agg(F.max(F.struct("n", "add", "flow")).alias("z"), F.min(F.struct("n", "flow")).alias("a"))
    ends = ends.select(key, "_block", (F.col("z.n") + 1).alias("n"), (alpha * F.col("z.flow") + stay * F.col("z.add")).alias("add"), F.col("a.flow").alias("first"))
    begun = ends.repartition(key).sortWithinPartitions(key, "_block").mapInPandas(chained, f"`{key}` {kind}, _block long, mean double, seen long")
    hits = folded.join(begun, [key, "_block"]).withColumn("history_avg", F.pow(F.lit(stay), F.col("n")) * F.col("mean") + F.col("add"))
    hits = hits.filter((F.col("seen") + F.col("n") >= max(1, warmup)) & (F.col("flow") > factor * F.col("history_avg")))
    ratio = F.when(F.col("history_avg") != 0, F.col("flow") / F.col("history_avg"))
    return hits.select(key, order, "flow", "history_avg", ratio.alias("ratio"))
