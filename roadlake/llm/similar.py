"""Near copies by shingle similarity: texts whose sets of word shingles have a Jaccard similarity of `similarity` or more.

Equal sets are one node. MinHash signatures in BANDS bands of ROWS values bring together what may be similar: a pair at
similarity s shares no band with probability (1 - s^ROWS)^BANDS, which is 8e-5 at 0.8, the worst case, and less above.
Nodes linked by shared bands form families. A family's sets then meet, and every pair of the family is decided
exactly, whether or not it shares a band: two sets at `similarity` share one of their rarest shingles (the prefix
filter, with the counts at hand), so only sets that do are compared.

A family of up to BLOCK_BYTES of sets is one task's work. A larger one is split. First each of its sets is held against
HUBS of them, which joins nearly all of a group of near copies to one cluster by one comparison each. Sets of the
largest cluster need no more comparisons with each other; the others are dealt into blocks of BLOCK_BYTES, and each
block meets every block of the family in a task of its own, where pairs of one cluster are passed over. So a task holds
two blocks at most, and a group of near copies, however large, costs a pass over it for each block of its strays.

Defined results: a null or wordless text has the empty set, and empty sets are equal; fewer words than a shingle: the
whole sequence is the one shingle; repeated rows share a group; of null doc_ids the least other id of the group counts
(null if there is none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PAGE, bits_for, cut, text_of
from .components import components, thinned

SIMILARITY = 0.8
SHINGLE = 5
BANDS, ROWS = 40, 7
SEED = 42
#: Bytes of the sets that a task takes at once, and how many sets of a larger family all its sets are held against.
BLOCK_BYTES, HUBS = 32 << 20, 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 11
_rng = np.random.default_rng(SEED)
_FACTOR, _ADD = _rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a whole text's word shingles."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def node_of(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def print_of(own: np.ndarray) -> int:
    """SimHash of a set: bit i is that of most of its shingles."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(own), _CHUNK):
        bits += np.unpackbits(own[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(own), bitorder="little").view(np.int64)[0])


def bands_of(own: np.ndarray) -> np.ndarray:
    """A key for each band; none for the empty set."""
    if not len(own):
        return np.empty(0, np.int64)
    short = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(short), _CHUNK):
        least = np.minimum(least, (short[None, k : k + _CHUNK] * _FACTOR + _ADD).min(axis=1))
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def groups_of(sets: list[np.ndarray], similarity: float = SIMILARITY, label: np.ndarray | None = None) -> np.ndarray:
    """Label of each set: sets at `similarity` or more are linked, directly or through others, and so are those of one given label."""
    percent = round(100 * similarity)
    label = np.arange(len(sets)) if label is None else label.copy()
    size = np.array([len(s) for s in sets])
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(held), np.int64)
    rank[np.argsort(held, kind="stable")] = np.arange(len(held))
    begin = np.concatenate([[0], np.cumsum(size)])
    own = [np.sort(rank[code[begin[i] : begin[i + 1]]]) for i in range(len(sets))]
    lists: dict[int, list[int]] = {}
    mark = np.zeros(len(held), np.int64)
    for i in np.argsort(size, kind="stable").tolist():
        prefix = own[i][: size[i] - -(-percent * size[i] // 100) + 1].tolist()
        near = np.unique(np.array([j for t in prefix for j in lists.get(t, ())], np.int64))
        near = near[100 * size[near] >= percent * size[i]]
        mark[own[i]] = 1
        step = 16
        while len(near := near[label[near] != label[i]]):
            some, near, step = near[:step], near[step:], 2 * step
            both = np.add.reduceat(mark[np.concatenate([own[j] for j in some])], np.concatenate([[0], np.cumsum(size[some])[:-1]]))
            for j in some[100 * both >= percent * (size[i] + size[some] - both)]:
                label[label == label[j]] = label[i]
        mark[own[i]] = 0
        for t in prefix:
            lists.setdefault(t, []).append(i)
    return label


def families(hashed: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """node, label of the nodes that share a band with another or one of `links`(a, b), directly or through others."""
    rows = hashed.dropDuplicates(["node"]).select(F.explode("bands").alias("key"), "node")
    # Written out, so that the join has an exchange of its own and adaptive execution can split a band of many nodes.
    hubs = cut(rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).filter("hub < _last").drop("_last"))
    banded = rows.join(hubs, "key").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return components(thinned(banded if links is None else banded.unionByName(links)))


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and its shingles, once for each of `nodes` (and by chance for some others)."""
    bits = bits_for(nodes.count())
    at = F.pmod("node", F.lit(bits)) + 1
    found = nodes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    held = np.zeros(bits // 8, np.uint8)
    for r in found.toLocalIterator():
        held[(r["k"] - 1) * (PAGE // 8) : r["k"] * (PAGE // 8)] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = {}
            for text in batch.column(0):
                own = shingles(text.as_py(), shingle)
                node = node_of(own)
                bit = node % bits
                if known[bit >> 3] >> (bit & 7) & 1:
                    out[node] = own.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["node", "own"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "node long, own binary").dropDuplicates(["node"])


def linked(sets: DataFrame, similarity: float) -> DataFrame:
    """node, label for sets(family, node, own), by families that a task can hold and larger ones."""
    sets = cut(sets.withColumn("bytes", F.octet_length("own").cast("long")))
    totals = cut(sets.groupBy("family").agg(F.sum("bytes").alias("total")))
    large = totals.filter(F.col("total") > BLOCK_BYTES)
    # Families over BLOCK_BYTES: at most the bytes of all sets over that.
    if not large.limit(1).count():
        return decided(sets.withColumn("label", F.col("node")), ["family"], similarity)
    small = sets.join(large, "family", "left_anti").withColumn("label", F.col("node"))
    links = decided(small, ["family"], similarity).unionByName(split_up(sets, large, similarity))
    return components(links.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a <> b"))


def split_up(sets: DataFrame, large: DataFrame, similarity: float) -> DataFrame:
    """node, label links of the families of large(family, total): held against hubs, then strays against all in blocks."""
    sets = cut(sets.join(large, "family"))
    parts = F.ceil(F.col("total") / F.lit(float(BLOCK_BYTES))).cast("int")
    dealt = sets.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), parts).cast("int"))
    # A family's hubs: those of least hash within HUBS * 4 expected ones, from the family as a whole.
    near = sets.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 40)).cast("double") * F.col("total") < F.lit(float(1 << 40)) * 4 * HUBS * F.col("bytes"))
    order = Window.partitionBy("family").orderBy(F.xxhash64("node"), "node")
    hubs = near.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= HUBS).drop("_k")
    copies = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    to_hubs = held_against(dealt, copies, similarity)
    first = components(to_hubs.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a <> b"))
    sets = cut(sets.join(first, "node", "left").withColumn("label", F.coalesce("label", "node")))
    clusters = sets.groupBy("family", "label").agg(F.sum("bytes").alias("bytes"))
    main = clusters.groupBy("family").agg(F.max_by("label", F.struct("bytes", "label")).alias("_main"), F.max("bytes").alias("_bytes"))
    rows = sets.join(main, "family").withColumn("_stray", F.col("label") != F.col("_main"))
    n_main = F.ceil(F.col("_bytes") / F.lit(float(BLOCK_BYTES))).cast("int")
    n_stray = F.ceil((F.col("total") - F.col("_bytes")) / F.lit(float(BLOCK_BYTES))).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), n).cast("int")
    every = F.sequence(F.lit(0), n_stray - 1)
    # A stray of block i meets main blocks (i, -1 - j) and stray blocks (min, max); a set of the main cluster meets stray blocks only.
    mine = deal(F.greatest(n_stray, F.lit(1)))
    pairs = F.when(
        F.col("_stray"), F.concat(
            F.transform(F.sequence(F.lit(0), n_main - 1), lambda j: F.struct(mine.alias("i"), (-1 - j).alias("j"))),
            F.transform(every, lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))))
    pairs = pairs.otherwise(F.transform(every, lambda i: F.struct(i.alias("i"), (-1 - deal(n_main)).alias("j"))))
    met = rows.filter(n_stray > 0).withColumn("_p", F.explode(pairs)).select("family", "node", "own", "label", "_p.i", "_p.j")
    return to_hubs.unionByName(decided(met, ["family", "i", "j"], similarity))


def _sets_of_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each key in turn, from batches sorted by the first `keys` columns."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != last and rows:
                yield last, rows
                rows = []
            last = row[:keys]
            rows.append(row[keys:])
    if rows:
        yield last, rows


def _batch(nodes: list[int], labels: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(labels, pa.int64())], names=["node", "label"])


def decided(sets: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """node, label for sets(*keys, node, own, label): dealt by the keys and sorted, each task takes one group after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _sets_of_rows(batches, len(keys)):
            nodes = [n for n, _, _ in rows]
            _, given = np.unique([k for _, _, k in rows], return_inverse=True)
            label = groups_of([np.frombuffer(b, np.uint64) for _, b, _ in rows], similarity, given)
            first: dict[int, int] = {}
            yield _batch(nodes, [first.setdefault(k, n) for n, k in zip(nodes, label.tolist())])

    rows = sets.select(*keys, "node", "own", "label").repartition(*keys).sortWithinPartitions(*keys, "node")
    return rows.mapInArrow(run, "node long, label long")


def held_against(dealt: DataFrame, hubs: DataFrame, similarity: float) -> DataFrame:
    """node, label (a hub's node) for each set of dealt(family, part, node, own) and each hub of its part that is similar."""
    percent = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, []
        for batch in batches:
            nodes, labels = [], []
            for family, part, order, node, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (family, part) != key:
                    key, known = (family, part), []
                mine = np.frombuffer(own, np.uint64)
                if order == 0:
                    known.append((node, mine))
                    continue
                for hub, other in known:
                    if hub != node and 100 * min(len(mine), len(other)) >= percent * max(len(mine), len(other)):
                        both = len(np.intersect1d(mine, other, assume_unique=True))
                        if 100 * both >= percent * (len(mine) + len(other) - both):
                            nodes.append(node)
                            labels.append(hub)
            yield _batch(nodes, labels)

    columns = ["family", "part", "order", "node", "own"]
    rows = hubs.withColumn("order", F.lit(0)).select(columns).unionByName(dealt.withColumn("order", F.lit(1)).select(columns))
    return rows.repartition("family", "part").sortWithinPartitions("family", "part", "order", "node").mapInArrow(run, "node long, label long")


def with_node(rows: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([node_of(shingles(t, shingle)) for t in texts], dtype="int64")

    return rows.withColumn(name, run(text_of(text)))


def similar_groups(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, keep: list[str] | None = None,
    more: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """`keep` (default doc_id), node, label, component_id of every row: its set, its group and the group's least doc_id.

    more: candidate links (a, b) of nodes from (node, fp) of all rows, to be decided with those of the bands.
    """
    keep = keep or ["doc_id"]

    @F.pandas_udf("node long, fp long, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            own = [shingles(t, shingle) for t in texts]
            yield pd.DataFrame({"node": pd.Series([node_of(s) for s in own], dtype="int64"), "fp": pd.Series([print_of(s) for s in own], dtype="int64"), "bands": pd.Series([bands_of(s) for s in own], dtype=object)})

    hashed = cut(docs.select(*keep, run(text_of()).alias("_h")).select(*keep, "_h.*"))
    links = None if more is None else more(hashed.select("node", "fp"))
    family = cut(families(hashed, links).select(F.col("node"), F.col("label").alias("family")))
    labels = cut(linked(sets_of(docs, family, shingle).join(family, "node"), similarity))
    nodes = hashed.groupBy("node").agg(F.min("doc_id").alias("_first"))
    mine = cut(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = cut(mine.groupBy("label").agg(F.min("_first").alias("component_id")))
    named = cut(mine.join(least, "label").select(F.col("node").alias("_node"), "label", "component_id"))
    return hashed.drop("bands", "fp").join(named, F.col("node") == F.col("_node")).drop("_node")
