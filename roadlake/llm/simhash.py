"""SimHash near-duplicates: fingerprints linked at a few differing bits, found by pigeonring chains.

The 64 bits are a ring of M segments. If two fingerprints differ in at most t
bits, some segment starts a chain whose every prefix of l segments differs in
at most floor(l * t / M) bits. For t = 3 and M = 4: 0 in the first, 1 in the
first two, 2 in three, 3 in all. The budgets of the first two segments are
made into an equi-join: one side holds the value of each segment and the next,
the other also each value with one zero bit of the next segment set (of two
values that differ in one bit, one has a zero there). Candidates then pass the
third budget and the full distance. Only distinct fingerprints take part, so a
group of equal copies is one row. Components need no link for each pair: a list
of one key is read as a whole, and each fingerprint in it gets at most one link,
to its group within the list (`sparse_links`); a list of over LIST rows is dealt
in blocks, each pair of which is one task's, so a dense ball of fingerprints is
neither one task's work nor written out by pairs. Every near pair shares a key,
so the components are those of all pairs.

Defined results: a null or wordless text has fingerprint zero and links like
any other; fewer words than a shingle: the whole sequence is the one shingle;
repeated rows share a component; with null doc_ids the least other id of the
component counts (null if there is none); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import unite
from .common import cut, free_name, may_hold, table, text_of, without
from .components import components
from .similar import similar_groups, with_node

SEED = 42
SHINGLE = 3
MOST_BITS = 3
SEGMENTS, SEGMENT_BITS = 4, 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 16
#: Rows of a key's list that one task takes.
LIST = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    set_bits = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        part = words[k : k + _CHUNK + shingle - 1] if n > 1 else words
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(name, run(text_of()))


def segment(value: Column, i: int) -> Column:
    return F.shiftrightunsigned(value, SEGMENT_BITS * (i % SEGMENTS)).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1).cast("long"))


def ring_keys() -> tuple[Column, Column]:
    """Keys of `fp` for each segment and the next: as they are, and with one zero bit of the next set."""
    key = lambda i, follow: F.shiftleft(F.lit(i).cast("long") * (1 << SEGMENT_BITS) + segment(F.col("fp"), i), SEGMENT_BITS).bitwiseOR(follow)
    flips = [F.lit(1 << b).cast("long") for b in range(SEGMENT_BITS)]
    exact = F.array(*[key(i, segment(F.col("fp"), i + 1)) for i in range(SEGMENTS)])

    def one_more(i: int) -> Column:
        follow = segment(F.col("fp"), i + 1)
        return F.transform(F.filter(F.array(*flips), lambda b: follow.bitwiseAND(b) == 0), lambda b: key(i, follow.bitwiseOR(b)))

    return exact, F.flatten(F.array(*map(one_more, range(SEGMENTS))))


def candidate_links(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints `fp` that differ in at most `most` (3 or fewer) bits."""
    assert most * 2 // SEGMENTS <= 1
    own, (exact, near) = prints.select("fp"), ring_keys()
    index = own.select(F.explode(exact).alias("key"), F.col("fp").alias("a"))
    probe = own.select(F.explode(F.concat(exact, near)).alias("key"), F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    start = F.shiftrightunsigned("key", 2 * SEGMENT_BITS)
    three = F.coalesce(*[F.when(start == i, sum(F.bit_count(segment(differ, i + j)) for j in range(3))) for i in range(SEGMENTS)])
    # Two fingerprints that share both segments meet from either side, others from one only.
    found = index.join(probe, "key").filter((F.col("a") != F.col("b")) & (three <= 3 * most // SEGMENTS) & (F.bit_count(differ) <= most))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sparse_links(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Links (a, b) of distinct fingerprints `fp` whose components are those of all pairs within `most` (3 or fewer) bits."""
    assert most * 2 // SEGMENTS <= 1
    budgets = [k * most // SEGMENTS for k in range(1, SEGMENTS + 1)]

    def near(a: np.ndarray, b: np.ndarray, start: int) -> np.ndarray:
        """Which of a (rows) and b (columns) pass the chain from segment `start`, then the full distance."""
        differ = (a[:, None] ^ b[None, :]).view(np.uint64)
        bits, ok = np.zeros(differ.shape, np.uint8), np.ones(differ.shape, bool)
        for k, budget in enumerate(budgets):
            bits += np.bitwise_count((differ >> np.uint64(SEGMENT_BITS * ((start + k) % SEGMENTS))).astype(np.uint16))
            ok &= bits <= budget
        return ok

    def linked(key: int, fp: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, code = np.unique(fp, return_inverse=True)
        label, own, other = np.arange(len(value)), np.flatnonzero(index), np.flatnonzero(~index)
        step = max(1, (1 << 22) // max(1, len(other)))
        for k in range(0, len(own), step):
            met = near(fp[own[k : k + step]], fp[other], key >> (2 * SEGMENT_BITS))
            for i in np.flatnonzero(met.any(axis=1)).tolist():
                unite(label, np.append(code[other[met[i]]], code[own[k + i]]))
        moved = np.flatnonzero(label != np.arange(len(value)))
        return value[label[moved]], value[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            if batch is not None:
                rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
                rest = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows)]
            if rest is None or not len(rest[0]):
                continue
            key, i, j, index, fp = rest
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            begin = np.concatenate([[0], new])
            end = np.append(new, len(key))
            if batch is not None:  # the last list may go on
                begin, end = begin[:-1], end[:-1]
            # Lists with an index row and a probe row of another fingerprint.
            total = np.concatenate([[0], np.cumsum(index)])
            held = total[end] - total[begin]
            some = np.flatnonzero((held > 0) & (end - begin > held) & (end - begin > 2) | (end - begin == 2) & (held == 1) & (fp[begin] != fp[np.maximum(end - 1, 0)]))
            found = [linked(int(key[begin[k]]), fp[begin[k] : end[k]], index[begin[k] : end[k]]) for k in some.tolist()]
            a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            last = end[-1] if len(end) else 0
            rest = [x[last:] for x in rest]

    exact, close = ring_keys()
    rows = prints.select(F.explode(exact).alias("key"), F.lit(True).alias("index"), "fp").unionByName(
        prints.select(F.explode(F.concat(exact, close)).alias("key"), F.lit(False).alias("index"), "fp"))
    long = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LIST))
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(LIST)).cast("int"), F.lit(1))
    own, every = F.pmod(F.xxhash64("fp"), parts).cast("int"), F.sequence(F.lit(0), parts - 1)
    meet = F.transform(every, lambda x: F.when(F.col("index"), F.struct(own.alias("i"), x.alias("j"))).otherwise(F.struct(x.alias("i"), own.alias("j"))))
    dealt = rows.join(long, "key", "left").withColumn("_m", F.explode(meet)).select("key", "_m.i", "_m.j", "index", "fp")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, most: int = MOST_BITS, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """`keep` (default doc_id), fp, component_id of every row."""
    keep = keep or ["doc_id"]
    hashed = cut(with_fingerprint(docs, shingle=shingle).select(*keep, "fp"))
    prints = cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    labels = cut(components(sparse_links(prints, most)))
    mine = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    mine = cut(mine)
    least = cut(mine.groupBy("label").agg(F.min("_first").alias("component_id")))
    named = cut(mine.join(least, "label").select(F.col("fp").alias("_fp"), "component_id"))
    return hashed.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def print_links(hashed: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Links (a, b) of nodes whose components are those of all pairs of fingerprints within `most` bits; hashed(node, fp).

    A node links to the least one of its fingerprint, which stands for it.
    """
    first = cut(hashed.groupBy("fp").agg(F.min("node").alias("first")))
    same = hashed.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    name = lambda end: first.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}"))
    near = cut(sparse_links(first.select("fp"), most)).join(name("a"), "a").join(name("b"), "b")
    return same.distinct().unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of similar texts, with the columns of docs.

    Texts are similar if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates are texts
    whose SimHash fingerprints over these shingles share a pigeonring key and are near, and, since most pairs at that
    similarity differ in more bits than it can search, those that share a MinHash band; each is decided exactly
    (see similar.py).

    The row that stays is the one of the group's least doc_id; where several texts or rows carry that doc_id, one of them. Rows without
    a doc_id cannot be named and stay. Ids alone decide where each doc_id has one row; rows of repeated ids are decided
    by id and text.
    """
    links = cut(similar_groups(docs.select("doc_id", "text"), more=print_links).filter("doc_id is not null"))
    ids = cut(links.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("least")).filter("n > 1 or doc_id <> least"))
    once = without(docs, ids)
    repeated = ids.filter("n > 1").select("doc_id")
    if not repeated.limit(1).count():
        return once
    first = links.filter("doc_id = component_id").groupBy("label", F.col("doc_id").alias("_keep")).agg(F.min("node").alias("_node")).drop("label")
    flag = free_name(docs, "_flag")
    rows = may_hold(docs, repeated, "doc_id", flag).filter(F.col(flag)).drop(flag)
    rows = with_node(rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row")), "row.text", "_own")
    rows = rows.join(repeated, F.col("row.doc_id") == F.col("doc_id"), "left_semi")
    rows = rows.join(first, (F.col("row.doc_id") == F.col("_keep")) & (F.col("_own") == F.col("_node")))
    return once.unionByName(rows.groupBy("_keep", "_node").agg(F.first("row").alias("row")).select("row.*"))


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
