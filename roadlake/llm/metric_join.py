"""Embedding near-duplicates: an exact metric range join of the vectors of one label, at a cosine of `least` or more.

On the unit sphere a cosine of s is the distance r = sqrt(2 - 2s). The vectors of a label and length are a cell. A cell
of more than LEAF vectors is partitioned by PIVOTS of its own vectors: each goes home to its nearest pivot, in a ring around
it where the distances leave a gap, and the triangle inequality says which other parts need a copy of it. A vector q within
r of some v that is at home in the ring lo to hi of pivot j has lo - r <= d(q, j) <= hi + r, and, as d(v, j) <= d(v, i) for
every pivot i, d(q, j) <= d(q, i) + 2r. So all links of a vector lie in its home part, and parts join independently. Parts
that would mostly hold copies of each other make one, so vectors without structure are not multiplied, and parts are
partitioned again until they are small or a step does not help (the largest part keeps over STUCK of the cell).

A part is then compared as a whole: blocks of BLOCK_BYTES of home vectors against blocks of all its vectors, each pair of
blocks one task's matrix product in double precision; cosines within 1e-9 of the bound are computed again by one sum in
fixed order, so both sides of a pair agree. A task returns counts and one link a vector (its group within the task), no
pairs. Equal vectors of a label are one vector with a number of copies.

Defined results: a null label, a null, empty or zero vector and one with a null or non-finite component links with
nothing, and so do vectors of different lengths; repeated rows and ids are vectors of their own and link; of null ids the
least other id of the component counts, and a component without ids has a null one (its rows are kept); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import grouped, unite
from .common import cut, table
from .components import components

LEAST_COSINE = 0.98
LEAF, PIVOTS, PART_ROWS = 512, 16, 1 << 14
#: A step that leaves over this share of a cell in one part ends its partitioning; parts that share over MIXED of the smaller one are joined.
STUCK, MIXED = 0.75, 0.5
RINGS = 256
BLOCK_BYTES, TILE = 16 << 20, 1 << 21
#: Cosines this near to the bound are computed again; what distances may be off by (the root of a rounding error).
_DOUBT, _SLACK = 1e-9, 1e-6


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of one length as rows, in double precision."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def measured(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """rows(cell, n, node, home, copies, vector) with `far`, the distances to the pivots(cell, n, vector) of their cell.

    Cells are dealt by rows, PART_ROWS a task, each with a copy of the cell's pivots.
    """
    kind = rows.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, _), t in grouped(batches, 2):
            first = t.column("first").to_numpy()
            x = units(t.column("vector"))
            own = t.filter(pa.array(~first))
            heads = x[first][np.argsort(t.column("node").to_numpy()[first])]  # in one order in every task of the cell
            far = np.sqrt(np.maximum(0, 2 - 2 * (x[~first] @ heads.T)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1], pa.int32()), pa.array(far.reshape(-1)))
            yield from own.select(["cell", "node", "home", "copies", "vector"]).append_column("far", lists).combine_chunks().to_batches()

    parts = F.ceil(F.col("n") / F.lit(PART_ROWS)).cast("int")
    own = rows.select("cell", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.lit(False).alias("first"), "node", "home", "copies", "vector")
    heads = pivots.select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("first"), "node", F.lit(True).alias("home"), F.lit(0).cast("long").alias("copies"), "vector")
    dealt = own.unionByName(heads).repartition("cell", "part").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(run, f"cell string, node long, home boolean, copies long, vector {kind}, far array<double>")


def joined_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """cell, at, child, stuck from one cell's (at, guest, n): homes where guest = at, else homes of `at` that `guest` needs a copy of."""
    homes = {int(a): int(n) for a, g, n in zip(pdf["at"], pdf["guest"], pdf["n"]) if a == g}
    child = {a: a for a in homes}
    shared: dict[tuple[int, int], int] = {}
    for a, g, n in zip(pdf["at"], pdf["guest"], pdf["n"]):
        if a != g:
            pair = (min(int(a), int(g)), max(int(a), int(g)))
            shared[pair] = shared.get(pair, 0) + int(n)
    for (a, b), n in shared.items():
        if n > MIXED * min(homes[a], homes[b]) and child[a] != child[b]:
            old, new = max(child[a], child[b]), min(child[a], child[b])
            child = {k: new if c == old else c for k, c in child.items()}
    sizes: dict[int, int] = {}
    for a, c in child.items():
        sizes[c] = sizes.get(c, 0) + homes[a]
    stuck = max(sizes.values()) > STUCK * sum(homes.values())
    return pd.DataFrame({"cell": pdf["cell"].iloc[0], "at": list(child), "child": list(child.values()), "stuck": stuck})


def partitioned(rows: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """One step for rows(cell, n, node, home, copies, vector): the rows of the new parts, and those of cells that it does not help."""
    draw = F.pmod(F.xxhash64("node", "cell"), F.lit(1 << 40))
    # The home vectors of least hash, among some 4 * PIVOTS of the cell: its own rows only, so the window stays small.
    near = rows.filter("home").filter(draw.cast("double") * F.col("n") < F.lit(float(1 << 40)) * 4 * PIVOTS)
    order = Window.partitionBy("cell").orderBy(draw, "node")
    pivots = cut(near.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= PIVOTS).select("cell", "n", "node", "vector"))
    chosen = cut(pivots.select("cell").distinct())
    unseen = rows.join(chosen, "cell", "left_anti").drop("n")
    far = cut(measured(rows.join(chosen, "cell", "left_semi"), pivots))
    width = max(reach, 0.05) / 2
    d = F.array_min("far")
    far = far.withColumn("near", F.array_position("far", d).cast("int") - 1).withColumn("bin", F.floor(d / width).cast("int"))
    # At most 2 / width bins a pivot: a ring starts where two bins before it are empty.
    bins = far.filter("home").groupBy("cell", "near").agg(F.array_sort(F.collect_set("bin")).alias("b"))
    ends = F.filter(F.sequence(F.lit(1), F.size("b") - 1), lambda i: (i > 0) & (F.get("b", i) - F.get("b", i - 1) > 2))
    starts = bins.select("cell", F.struct("near", F.transform(F.when(F.size("b") > 1, ends).otherwise(F.array().cast("array<int>")), lambda i: F.get("b", i)).alias("at")).alias("s"))
    starts = cut(starts.groupBy("cell").agg(F.map_from_entries(F.collect_list("s")).alias("starts")))
    ring = F.size(F.filter(F.col("starts")[F.col("near")], lambda x: x <= F.col("bin")))
    far = far.join(starts, "cell").withColumn("at", F.when(F.col("home"), F.col("near") * RINGS + ring)).drop("starts", "bin")
    parts = cut(far.filter("home").groupBy("cell", "at").agg(F.count("*").alias("n"), F.min(d).alias("lo"), F.max(d).alias("hi")))
    shells = cut(parts.groupBy("cell").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("shells")))

    def needs(p: Column) -> Column:
        x = F.get("far", F.floor(p["at"] / RINGS).cast("int"))
        return ~p["at"].eqNullSafe(F.col("at")) & (x >= p["lo"] - (reach + _SLACK)) & (x <= p["hi"] + (reach + _SLACK)) & (x <= d + (2 * reach + _SLACK))

    guests = F.transform(F.filter("shells", needs), lambda p: p["at"])
    placed = cut(far.join(shells, "cell").withColumn("guests", guests).drop("far", "shells", "near"))
    shared = placed.filter("home").select("cell", "at", F.explode("guests").alias("guest")).groupBy("cell", "at", "guest").agg(F.count("*").alias("n"))
    shared = parts.select("cell", "at", F.col("at").alias("guest"), "n").unionByName(shared)
    children = shared.groupBy("cell").applyInPandas(joined_parts, "cell string, at int, child int, stuck boolean")
    children = cut(children.groupBy("cell").agg(F.first("stuck").alias("stuck"), F.map_from_entries(F.collect_list(F.struct("at", "child"))).alias("child")))
    placed = placed.join(children, "cell")
    own = F.col("child")[F.col("at")]
    others = F.array_distinct(F.transform("guests", lambda j: F.col("child")[j]))
    visits = F.transform(F.when(F.col("home"), F.array_remove(others, own)).otherwise(others), lambda c: F.struct(c.alias("to"), F.lit(False).alias("home")))
    goes = F.when(F.col("home"), F.concat(F.array(F.struct(own.alias("to"), F.lit(True).alias("home"))), visits)).otherwise(visits)
    split = placed.filter("not stuck").withColumn("_g", F.explode(goes))
    split = split.select(F.concat("cell", F.lit("."), F.col("_g.to").cast("string")).alias("cell"), "node", F.col("_g.home").alias("home"), "copies", "vector")
    columns = ["cell", "node", "home", "copies", "vector"]
    return cut(split), cut(placed.filter("stuck").select(columns).unionByName(unseen.select(columns)))


def parts_of(rows: DataFrame, reach: float) -> DataFrame:
    """rows(cell, node, home, copies, vector) in parts in which every home vector meets all vectors within `reach`."""
    done = []
    while True:
        sizes = cut(rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("_live")).filter("_live").drop("_live"))
        sized = rows.join(sizes, "cell")
        done.append(sized.filter(F.col("n") <= LEAF).drop("n"))
        if not sizes.filter(F.col("n") > LEAF).limit(1).count():
            break
        rows, whole = partitioned(sized.filter(F.col("n") > LEAF), reach)
        done.append(whole)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def matches(left: np.ndarray, right: np.ndarray, weights: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight within the bound of each left vector, and a label for each right one and then each left one that is not `own` (its place on the right, -1: none)."""
    place = np.where(own >= 0, own, len(right) + np.cumsum(own < 0) - 1)
    label = np.arange(len(right) + int((own < 0).sum()))
    total = np.zeros(len(left), np.int64)
    step = max(1, TILE // max(1, len(right)))
    for k in range(0, len(left), step):
        cos = left[k : k + step] @ right.T
        near = cos >= least - _DOUBT
        for i, j in zip(*np.nonzero(near & (cos < least + _DOUBT))):
            near[i, j] = (left[k + i] * right[j]).sum() >= least
        for i in range(len(near)):
            at = np.flatnonzero(near[i])
            total[k + i] = weights[at].sum()
            unite(label, np.append(at, place[k + i]))
    return total, label


def compared(rows: DataFrame, least: float) -> DataFrame:
    """node, links, peer: for home vectors what a task counts (copies within the bound, its own too), and a vector of its group within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, 3):
            x, node = units(t.column("vector")), t.column("node").to_numpy()
            is_left, is_right = t.column("left").to_numpy(), t.column("right").to_numpy()
            rows_left, rows_right = np.flatnonzero(is_left), np.flatnonzero(is_right)
            if not len(rows_left) or not len(rows_right):
                continue
            place = np.full(len(node), -1)
            place[rows_right] = np.arange(len(rows_right))
            total, label = matches(x[rows_left], x[rows_right], t.column("copies").to_numpy()[rows_right], place[rows_left], least)
            every = np.concatenate([node[rows_right], node[rows_left][place[rows_left] < 0]])
            moved = np.flatnonzero(label != np.arange(len(label)))
            nodes, links = np.concatenate([node[rows_left], every[moved]]), np.concatenate([total, np.zeros(len(moved), np.int64)])
            peers = np.concatenate([node[rows_left], every[label[moved]]])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(peers)], names=["node", "links", "peer"])

    n = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(float(BLOCK_BYTES)))).cast("int")
    sizes = cut(rows.groupBy("cell").agg((F.sum(F.size("vector")).cast("long") * 8).alias("bytes")))
    blocks = rows.join(sizes, "cell").withColumn("b", F.pmod(F.xxhash64("node", F.lit("block")), n).cast("int")).withColumn("n", n)
    every = F.sequence(F.lit(0), F.col("n") - 1)
    meet = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    as_left = F.transform(F.filter(every, lambda j: (j != F.col("b")) & F.col("home")), lambda j: meet(F.col("b"), j, F.lit(True), F.lit(False)))
    as_right = F.transform(every, lambda i: meet(i, F.col("b"), (i == F.col("b")) & F.col("home"), F.lit(True)))
    dealt = blocks.withColumn("_m", F.explode(F.concat(as_left, as_right))).select("cell", "_m.i", "_m.j", "_m.left", "_m.right", "node", "copies", "vector")
    return dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node").mapInArrow(run, "node long, links long, peer long")


def near_vectors(rows: DataFrame, least: float = LEAST_COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    every = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    good = every.filter(F.col("label").isNotNull() & usable(F.col("vector")))
    reach = sqrt(max(0.0, 2 - 2 * least))
    distinct = good.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    groups = cut(nodes.select("label", F.size("vector").alias("length")).distinct().withColumn("cell", F.monotonically_increasing_id().cast("string")))
    cells = nodes.withColumn("length", F.size("vector")).join(groups, ["label", "length"])
    cells = cut(cells.select("cell", "node", F.lit(True).alias("home"), "copies", "vector"))
    found = cut(compared(parts_of(cells, reach), least))
    links = found.groupBy("node").agg((F.sum("links") - 1).alias("n_links"))
    labels = components(found.filter("node <> peer").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    named = nodes.select("node", "first").join(labels.withColumnRenamed("label", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    named = cut(named)
    least_id = cut(named.groupBy("group").agg(F.min("first").alias("component_id")))
    known = cut(named.join(least_id, "group").join(links, "node").select("node", "n_links", "component_id"))
    known = cut(nodes.select("node", "label", "vector").join(known, "node").drop("node"))
    hits = good.join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    rest = every.filter(~(F.col("label").isNotNull() & usable(F.col("vector")))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return hits.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (
    select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.98
), reached(a, b) as (
    select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a
), least as (select a, min(b) as m from reached group by a),
degree as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id <= coalesce(m, vec_id) as kept
from embeddings e left join degree d on d.a = e.vec_id left join least l on l.a = e.vec_id
"""
