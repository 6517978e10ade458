"""Source divergence: how far the term distributions of the sources of a language lie apart, and by which terms.

The counts of a language are a matrix of sources by kept terms, most frequent first. A source's smoothed shares are
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), so every empty cell of a row has one value, that of a count of 0. The matrix is
cut into blocks of SIDE rows and SIDE columns, each a K-squared tree (K = 2): a quadrant is empty or has four children, down
to leaves of LEAF x LEAF cells. The distance of two sources is a sum over the terms. For all pairs of a row block with
another (or itself) the two trees are walked together over the same columns: where both quadrants are empty, each pair of
rows gets the difference of its two empty values times the number of columns, at once; where they are not, the walk goes
on into the quadrants, and at leaves the cells are compared. A task takes two row blocks and a stripe of STRIPE columns.

All arithmetic is exact: shares by decimals in Spark, sums of at most 2 * 10^9 + 2 V in 64 bits.

Defined results: null texts, languages and sources count as ''; a (lang, source) without kept terms has empty cells only; a
language without kept terms has distances of 0; a language with one source has no pairs; repeated rows count as often as
they occur; doc_id is not read, other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import grouped
from .common import cut, table, text_of, width

LEAST_DOCS, TOP_TERMS = 30, 50
SIDE, LEAF, STRIPE = 256, 8, 4096
#: Cells that are compared at once, and distinct terms that a task counts before it hands them on.
CELLS, FLUSH = 1 << 21, 1 << 18
_LETTERS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` in a whole text, A-Z lower-cased."""
    return text.encode("utf-8").translate(_LETTERS).split()


def term_counts(texts: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of texts(lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            rows = [(*key, t.decode("utf-8"), n, docs[t]) for key, (words, docs) in held.items() for t, n in words.items()]
            held.clear()
            columns = zip(*rows) if rows else [()] * 5
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words, docs = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text.as_py())
                words.update(found)
                docs.update(set(found))
            if sum(len(w) for w, _ in held.values()) > FLUSH:
                yield out()
        yield out()

    rows = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"1 + ({wide(count)} + 5) * 1000000000 div ({wide(total)} + 5 * {wide(terms)})")


def numbered(kept: DataFrame) -> DataFrame:
    """kept(lang, term, total) with `col`, the place within the language by total, from 0: sorted by ranges, whose counts are summed."""
    parts = kept.repartitionByRange(width(kept.sparkSession), F.col("lang"), F.desc("total"), F.col("term"))
    parts = cut(parts.withColumn("_p", F.spark_partition_id()))
    starts = parts.groupBy("lang", "_p").agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(Window.partitionBy("lang").orderBy("_p")) - F.col("_n")).drop("_n")
    order = Window.partitionBy("lang", "_p").orderBy(F.desc("total"), "term")
    return parts.join(starts, ["lang", "_p"]).withColumn("col", F.col("_start") + F.row_number().over(order) - 1).drop("_p", "_start")


def pyramid(block: np.ndarray) -> list[np.ndarray]:
    """The tree of a block: for each size of quadrants, from single cells up, whether it holds anything."""
    levels = [block != 0]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append(x[::2, ::2] | x[1::2, ::2] | x[::2, 1::2] | x[1::2, 1::2])
    return levels


def walked(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray, rows: tuple[int, int], same: bool, total: np.ndarray, blank: list[np.ndarray]) -> None:
    """Adds to `total`, for rows of a by rows of b, the differences at leaves, and to `blank` by size of quadrants the columns that are empty in both."""
    trees, leaf = (pyramid(a), pyramid(b)), LEAF.bit_length() - 1
    i, j, c = (np.zeros(1, np.int64) for _ in range(3))
    for level in range(len(trees[0]) - 1, -1, -1):
        inside = (i << level < rows[0]) & (j << level < rows[1]) & ((i <= j) | (not same))
        i, j, c = i[inside], j[inside], c[inside]
        some = trees[0][level][i, c] | trees[1][level][j, c]
        np.add.at(blank[level], (i[~some], j[~some]), 1 << level)
        i, j, c = i[some], j[some], c[some]
        if level == leaf or not len(i):
            break
        i, j, c = (np.concatenate([2 * x + (k >> s & 1) for k in range(8)]) for s, x in ((0, i), (1, j), (2, c)))
    cut_up = lambda x, empty: np.where(x == 0, empty[:, None], x).reshape(len(x) // LEAF, LEAF, -1, LEAF).swapaxes(1, 2)
    full_a, full_b = cut_up(a, empty_a), cut_up(b, empty_b)
    tiles = total.reshape(len(a) // LEAF, LEAF, len(b) // LEAF, LEAF).swapaxes(1, 2)
    step = max(1, CELLS // LEAF**3)
    for k in range(0, len(i), step):
        x, y, z = i[k : k + step], j[k : k + step], c[k : k + step]
        np.add.at(tiles, (x, y), np.abs(full_a[x, z][:, :, None, :] - full_b[y, z][:, None, :, :]).sum(axis=3))


def distances(cells: DataFrame) -> DataFrame:
    """lang, i, j, value for i < j from cells(lang, bi, bj, stripe, v, side, row, col, p); col -1: the row's empty value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, bi, bj, stripe), t in grouped(batches, 4):
            side, row, col, p = (t.column(x).to_numpy() for x in ("side", "row", "col", "p"))
            columns = min(STRIPE, max(0, t.column("v")[0].as_py() - stripe * STRIPE))
            same, row, col = bi == bj, row % SIDE, np.where(col < 0, -1, col - stripe * STRIPE)
            empty, sizes = np.zeros((2, SIDE), np.int64), [0, 0]
            for s in range(2):
                heads = (col < 0) & (side == (0 if same else s))
                empty[s, row[heads]] = p[heads]
                sizes[s] = int(row[heads].max()) + 1
            total = np.zeros((SIDE, SIDE), np.int64)
            blank = [np.zeros((SIDE >> k, SIDE >> k), np.int64) for k in range(SIDE.bit_length())]
            n_blocks = -(-columns // SIDE)
            for k in range(n_blocks):
                pair = []
                for s in range(1 if same else 2):
                    at = (side == s) & (col >= k * SIDE) & (col < (k + 1) * SIDE)
                    block = np.zeros((SIDE, SIDE), np.int64)
                    block[row[at], col[at] - k * SIDE] = p[at]
                    pair.append(block)
                walked(pair[0], pair[-1], empty[0], empty[1], (sizes[0], sizes[1]), same, total, blank)
            none = sum(np.repeat(np.repeat(x, 1 << k, axis=0), 1 << k, axis=1) for k, x in enumerate(blank))
            # Columns past the last term were counted as empty.
            total += (none - (n_blocks * SIDE - columns)) * np.abs(empty[0][:, None] - empty[1][None, :])
            x, y = np.meshgrid(np.arange(sizes[0]), np.arange(sizes[1]), indexing="ij")
            want = (x < y) if same else np.ones_like(x, bool)
            x, y = x[want], y[want]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(x), pa.string()), pa.array(x + bi * SIDE, pa.int64()), pa.array(y + bj * SIDE, pa.int64()), pa.array(total[x, y], pa.int64())],
                names=["lang", "i", "j", "value"])

    keys = ["lang", "bi", "bj", "stripe"]
    rows = cells.select(*keys, "v", "side", "row", "col", "p").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "lang string, i long, j long, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances of each source to the others of its language, and its most over-used terms."""
    texts = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))
    counts = cut(term_counts(texts))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = cut(numbered(kept))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    cells = cut(counts.drop("docs").join(kept, ["lang", "term"]))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own", "v", "all"])
    # One row a source, so this window holds the sources of a language.
    groups = groups.withColumn("row", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("own"), "source")).cast("long") - 1)
    groups = cut(groups.withColumn("rows", F.count("*").over(Window.partitionBy("lang"))))
    of_group = groups.select("lang", "source", "own", "v", "all", "row", "rows")
    cells = cut(cells.join(of_group, ["lang", "source"]).withColumn("p", share("n", "own", "v")).withColumn("q", share("total", "all", "v")))

    heads = of_group.withColumn("p", F.when(F.col("v") > 0, share("0", "own", "greatest(v, 1)")).otherwise(F.lit(0))).withColumn("col", F.lit(-1).cast("long"))
    stripes = F.greatest(F.lit(1), F.ceil(F.col("v") / STRIPE)).cast("long")
    placed = cells.withColumn("stripe", F.floor(F.col("col") / STRIPE)).select("lang", "v", "row", "rows", "col", "p", "stripe")
    placed = placed.unionByName(heads.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), stripes - 1))).select("lang", "v", "row", "rows", "col", "p", "stripe"))
    block = F.floor(F.col("row") / SIDE)
    blocks = F.ceil(F.col("rows") / SIDE)
    meet = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.struct(F.least(block, x).alias("bi"), F.greatest(block, x).alias("bj"), (block > x).cast("int").alias("side")))
    placed = placed.withColumn("_m", F.explode(meet)).select("lang", "_m.bi", "_m.bj", "_m.side", "stripe", "v", "row", "col", "p")
    found = cut(distances(placed))

    name = lambda place, column: groups.select("lang", F.col("row").alias(place), F.col("source").alias(column))
    pairs = found.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"]).select("lang", "source", "item", "value")
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", "value", both.alias("_s")).select("lang", "_s.source", F.lit("pair").alias("part"), "_s.item", "value")
    over = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = pairs.withColumn("rank", F.row_number().over(order)).unionByName(over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_quadtree_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
    select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
    from documents
), occurring as (select id, lang, source, unnest(ts) as term from d),
kept as (select lang, term, count(*) as total from occurring group by 1, 2 having count(distinct id) >= 30),
langs as (select lang, count(*) as v, sum(total) as alln from kept group by 1),
cells as (select o.lang, o.source, o.term, count(*) as n from occurring o join kept k on k.lang = o.lang and k.term = o.term group by 1, 2, 3),
totals as (select lang, source, sum(n) as own from cells group by 1, 2),
groups as (
    select g.lang, g.source, coalesce(own, 0) as own, coalesce(v, 0) as v, coalesce(alln, 0) as alln
    from (select distinct lang, source from d) g left join totals t on t.lang = g.lang and t.source = g.source left join langs l on l.lang = g.lang
), shares as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
        1 + ((coalesce(c.n, 0) + 5)::hugeint * 1000000000) // (g.own + 5 * g.v) as p, 1 + ((k.total + 5)::hugeint * 1000000000) // (g.alln + 5 * g.v) as q
    from groups g join kept k on k.lang = g.lang left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term
), apart as (
    select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
), both_parts as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
    union all
    select lang, source, 'term', term, (p - q)::bigint from shares where n > 0 and p > q
)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from both_parts
qualify part = 'pair' or rank <= 50
"""
