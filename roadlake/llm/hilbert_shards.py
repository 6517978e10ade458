"""Sharding: Hilbert-curve order over quantised metadata, cut into runs.

Three metadata columns (language, source, text size) are quantised to steps of
about equal numbers of rows, in the order of their values: the cuts are
quantiles, from a sketch of fixed size, of the size and of the first bytes in
which a column's texts differ. The cells of that grid are ordered along a
Hilbert curve, so rows that lie near each other in any of the three lie in few
shards and the minima and maxima of a shard (`zones`) prune reads along all of
them. The run is cut by rank, so shards differ by one row at most (law `rows`),
however large a cell is. Native: only DataFrame functions.

No task gathers a cell: a cell's rows are dealt by a hash of doc_id into as
many buckets as its share of all rows asks for, buckets are counted, and the
running sum goes over the bucket table only, whose size depends on the grid and
the parallelism, not on the data. A row that is repeated more often than a
bucket should hold gets buckets of its own, and its copies are dealt by a number
that is written with them. The cuts are read once, so a lost task finds the same
cells again.

Defined results: a null text counts 8 bytes and the crc of the empty text; null
language, source or doc_id are values of their own, below all others; repeated
rows each get a place (ties are interchangeable); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table, text_of, width

BITS = 4
DIMS = 3
#: What tells rows apart (_id: doc_id as text, null as no text).
SAME = ("_id", "text_crc32", "size")


def hilbert_index(point: Column, dims: int, bits: int) -> Column:
    """The curve index of an array of integers below 2**bits (transpose form, Gray code, interleave).

    A fold over the levels keeps the expression short: each level refers to the one before by a lambda variable.
    """
    levels = [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in levels for i in range(dims)])

    def step(x: Column, s: Column) -> Column:
        on = F.get(x, s["i"]).bitwiseAND(s["q"]) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, s["i"])).bitwiseAND(s["q"] - 1)
        return F.transform(x, lambda v, j: F.when(on, F.when(j == 0, v.bitwiseXOR(s["q"] - 1)).otherwise(v)).otherwise(
            F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v)))

    def gray(x: Column) -> Column:
        """Running exclusive or along the dimensions."""
        return F.transform(x, lambda _, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

    def flipped(x: Column) -> Column:
        last = F.get(x, F.lit(dims - 1))
        flip = F.aggregate(F.array(*map(F.lit, levels)), F.lit(0), lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
        return F.transform(x, lambda v: v.bitwiseXOR(flip))

    def joined(x: Column) -> Column:
        places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)])
        bit = lambda s: F.get(x, s["i"]).bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(bits)]), s["b"] + 1))
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, s: a * 2 + F.when(bit(s) != 0, 1).otherwise(0))

    # Each of the four parts reads the one before through a lambda, so none is written out twice.
    held = F.array(F.aggregate(steps, point, step))
    for part in (gray, flipped, joined):
        held = F.transform(held, part)
    return F.get(held, F.lit(0))


def leading(column: Column, skip: int) -> Column:
    """Number of the seven bytes after the first `skip`: ordered as the texts are."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "utf-8"), skip + 1, 7)), 14, "0"), 16, 10).cast("long")


def common_bytes(low: str | None, high: str | None) -> int:
    """Bytes that all texts from low to high begin with."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def steps_of(df: DataFrame, columns: list[str], bits: int) -> list[Column]:
    """For each whole-number column the step 0 (null) or 1 to 2**bits - 1, by quantiles of its values."""
    n = (1 << bits) - 1
    cuts = df.agg(*[F.percentile_approx(c, [k / n for k in range(1, n)], 100 * n).alias(c) for c in columns]).first()
    out = []
    for c in columns:
        held = F.array(*[F.lit(v).cast("long") for v in cuts[c] or ()]).cast("array<long>")
        out.append(F.when(F.col(c).isNull(), 0).otherwise(F.size(F.filter(held, lambda v: v < F.col(c))) + 1).cast("int"))
    return out


def repeated_rows(rows: DataFrame, buckets: int) -> DataFrame:
    """hilbert, _part, SAME, _hot, _subs: rows with over two buckets' worth of copies (fewer than buckets / 2), numbered from 1 in a part, and the buckets of each.

    Only parts of over four buckets' worth are counted row by row.
    """
    share = F.col("_n") * F.lit(buckets) / F.col("_total")
    crowded = rows.groupBy("hilbert", "_part").agg(F.count("*").alias("_n"), F.first("_total").alias("_total")).filter(share > 4).select("hilbert", "_part")
    copies = rows.join(F.broadcast(crowded), ["hilbert", "_part"], "left_semi").groupBy("hilbert", "_part", *SAME).agg(F.count("*").alias("_n"), F.first("_total").alias("_total"))
    order = W.partitionBy("hilbert", "_part").orderBy(*SAME)
    return copies.filter(share > 2).select("hilbert", "_part", *SAME, F.row_number().over(order).alias("_hot"), F.ceil(share).cast("int").alias("_subs"))


def assign(docs: DataFrame, shards: int = 24, bits: int = BITS, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard, slot, lang, source of every row; buckets: about how many are ranked apart."""
    spark = docs.sparkSession
    buckets = buckets or 16 * width(spark)
    size = F.octet_length(text_of()).cast("long") + 8
    ends = docs.agg(*[f(F.col(c).cast("string")).alias(f"{f.__name__}_{c}") for c in ("lang", "source") for f in (F.min, F.max)]).first()
    skip = {c: common_bytes(ends[f"min_{c}"], ends[f"max_{c}"]) for c in ("lang", "source")}
    slim = cut(docs.select(
        "doc_id", size.alias("size"), F.crc32(text_of()).alias("text_crc32"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        *[leading(F.col(c).cast("string"), skip[c]).alias(f"_{c}") for c in ("lang", "source")], size.alias("_size"), F.monotonically_increasing_id().alias("_copy")))
    dims = ["_lang", "_source", "_size"]
    slim = slim.withColumns(dict(zip(dims, steps_of(slim, dims, bits))))
    cells = slim.groupBy(*dims).agg(F.count("*").alias("_n")).withColumn("hilbert", hilbert_index(F.array(*dims), DIMS, bits))
    total = cells.agg(F.sum("_n").alias("_total"))
    # At most 2**(3 * bits) cells and as many rows here.
    parts = F.ceil(F.col("_n") * F.lit(buckets) / F.col("_total")).cast("int")
    cells = F.broadcast(cells.crossJoin(F.broadcast(total)).withColumn("_parts", parts).drop("_n"))
    rows = slim.join(cells, dims).withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("_parts")).cast("int"))
    rows = rows.join(F.broadcast(cut(repeated_rows(rows, buckets))), ["hilbert", "_part", *SAME], "left")
    rows = rows.withColumn("_hot", F.coalesce("_hot", F.lit(0))).withColumn("_sub", F.coalesce(F.pmod(F.xxhash64("_copy"), F.col("_subs")), F.lit(0)).cast("int"))
    place = ["hilbert", "_part", "_hot", "_sub"]
    starts = rows.groupBy(*place).agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(W.orderBy(*place).rowsBetween(W.unboundedPreceding, -1)))
    starts = F.broadcast(starts.select(*place, F.coalesce("_start", F.lit(0)).alias("_start")))
    own = W.partitionBy(*place).orderBy("doc_id", "text_crc32", "size")
    rows = rows.join(starts, place).withColumn("_rank", F.col("_start") + F.row_number().over(own) - 1)
    rows = rows.withColumn("shard", F.expr(f"cast((_rank * {shards}) div _total as int)"))
    slot = F.expr(f"_rank - (shard * _total + {shards - 1}) div {shards}")
    return rows.select("doc_id", "size", "text_crc32", "hilbert", "shard", slot.alias("slot"), "lang", "source")


def zones(assigned: DataFrame, columns: tuple[str, ...] = ("lang", "source", "size")) -> DataFrame:
    """Minimum and maximum of each column in each shard: a reader skips the shards whose range lacks its value."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]
    return assigned.groupBy("shard").agg(*ends)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", "lang", "source")
