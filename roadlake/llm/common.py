"""Shared helpers of the corpus operators: tables, words, rows dropped by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir  # noqa: F401

#: The white space that separates words; code points 0x20 and 0x09 to 0x0D.
WHITE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`."""
    return F.array_remove(F.split(F.translate(text, WHITE[1:], " " * 5), " "), "")


def let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front while df has it."""
    while name.lower() in map(str.lower, df.columns):
        name = "_" + name
    return name


#: Bits of a map of keys: 16 a key, within these bounds (128 MB at most: beyond some hundred million keys the map lets
#: more rows through, which are then joined). Maps are made in pages of PAGE bits.
LEAST_BITS, MOST_BITS, PAGE = 1 << 15, 1 << 30, 1 << 15


def bits_for(keys: int) -> int:
    """A power of two of bits for a map of so many keys."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys - 1).bit_length())) if keys else LEAST_BITS


def may_hold(docs: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """docs with a boolean `flag`: false for rows whose key is surely not among keys(key), and for null keys. No row is shuffled."""
    bits_all = bits_for(keys.count())
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits_all))
    at = slot(F.col(key)) + 1
    pages = keys.filter(F.col(key).isNotNull()).select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("page"))
    pages = pages.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    page, bits, place = (free_name(docs, n) for n in ("_page", "_bits", "_place"))
    rows = docs.withColumn(place, slot(F.col(key)))
    rows = rows.join(F.broadcast(pages.select(F.col("page").alias(page), F.col("bits").alias(bits))), F.expr(f"`{place}` div {PAGE} + 1") == F.col(page), "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.expr(f"cast(`{place}` % {PAGE} div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    held = F.shiftright(byte, 0).bitwiseAND(F.expr(f"shiftleft(1, cast(`{place}` % 8 as int))")) != 0
    return rows.withColumn(flag, F.coalesce(held & F.col(key).isNotNull(), F.lit(False))).drop(page, bits, place)


def without(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not among keys(key); rows without a key stay.

    Only rows that a map of the keys does not clear are joined with them, so whole texts are shuffled for the rows that
    go and a few by chance, not for those that stay. keys should be cheap to read twice, such as a checkpoint.
    """
    flag, gone = free_name(docs, "_flag"), free_name(docs, "_gone")
    rows = may_hold(docs, keys, key, flag)
    doubtful = rows.filter(F.col(flag)).join(keys.select(F.col(key).alias(gone)).distinct(), F.col(key) == F.col(gone), "left_anti")
    return rows.filter(~F.col(flag)).unionByName(doubtful).drop(flag)
