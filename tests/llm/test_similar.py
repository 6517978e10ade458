"""Near copies of the pipeline's stage against brute-force Jaccard."""

import random

import numpy as np
import pytest

import corpus_pipeline
from roadlake.llm import components, similar

from .helpers import docs, with_clashes


def five(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Least id of each row's group by all pairs."""
    sets, label = [five(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                label = [label[i] if x == label[j] else x for x in label]
    return {r[0]: min(q[0] for q, y in zip(rows, label) if y == x) for r, x in zip(rows, label)}


def edited():
    """Texts of 20 to 600 words with copies of up to 4 per cent of changed words, and a line that many share."""
    rng = np.random.default_rng(7)
    word = lambda: f"w{rng.integers(0, 5000)}"
    line, rows = [word() for _ in range(30)], []
    for _ in range(25):
        text = [word() for _ in range(rng.integers(20, 600))]
        text = line + text if rng.random() < 0.5 else text
        for _ in range(6):
            copy = list(text)
            for at in rng.integers(0, len(text), int(rng.uniform(0, 0.04) * len(text))):
                copy[at] = word()
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    return rows


def test_stage_keeps_one_of_each_similar_group(spark):
    rows = edited()
    want = brute(rows)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, with_clashes(docs(spark, rows)), "").collect()}
    assert got == set(want.values()) and 25 < len(got) < 110
    assert {r.doc_id: r.component_id for r in similar.similar_groups(docs(spark, rows)).collect()} == want
    assert similar.similar_groups(docs(spark, [])).count() == 0


def test_groups_are_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = []
    for _ in range(150):
        own = base[: rng.integers(20, 200)].copy()
        hit = rng.random(len(own)) < rng.uniform(0, 0.2)
        own[hit] = rng.integers(0, 1 << 60, hit.sum()).astype(np.uint64)
        sets.append(np.unique(own))
    label, want = similar.groups_of(sets).tolist(), list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(np.intersect1d(a, sets[j]))
            if 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                want = [want[i] if x == want[j] else x for x in want]
    same = lambda v: [[x == y for y in v] for x in v]
    assert same(label) == same(want) and 2 < len(set(want)) < 150


def test_bands_miss_few_pairs_at_the_bound():
    rng = np.random.default_rng(11)
    missed = 0
    for _ in range(1000):
        own = np.unique(rng.integers(0, 1 << 63, 360).astype(np.uint64))
        a, b = own[rng.permutation(len(own))[:324]], own[rng.permutation(len(own))[:324]]
        missed += not (similar.bands_of(np.sort(a)) == similar.bands_of(np.sort(b))).any()
    assert missed <= 3


def test_large_families_are_split_without_loss(spark, monkeypatch):
    """Blocks of a few sets: hubs, strays and blocks give the groups of all pairs."""
    rows = edited()
    rng = np.random.default_rng(13)
    base = [f"b{i}" for i in range(120)]
    for _ in range(80):  # a large group of copies of one text, some of them near others only
        copy = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 4))):
            copy[at] = f"n{rng.integers(0, 99)}"
        rows.append((len(rows), " ".join(copy), "en", "s", 1))
    want = brute(rows)
    monkeypatch.setattr(similar, "BLOCK_BYTES", 9000)
    monkeypatch.setattr(similar, "HUBS", 3)
    assert {r.doc_id: r.component_id for r in similar.similar_groups(docs(spark, rows)).collect()} == want


def test_one_of_each_with_repeated_ids(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(30))
    rows = [(1, text(1)), (1, text(2)), (2, text(1)), (3, text(2)), (3, text(3)), (4, text(4)), (4, text(4)), (None, text(4)), (5, text(5)), (5, text(5) + " more"), (6, text(6))]
    df = docs(spark, [(d, t, "en", "s", 1) for d, t in rows])
    from roadlake.llm import simhash

    got = sorted((str(r.doc_id), r.text.split("w")[0]) for r in simhash.one_of_each(df).collect())
    assert got == sorted([("1", "t1"), ("1", "t2"), ("3", "t3"), ("4", "t4"), ("5", "t5"), ("6", "t6"), ("None", "t4")])


def test_rows_without_keys(spark):
    from pyspark.sql import functions as F

    from roadlake.llm.common import without

    df = spark.range(5000).select(F.when(F.col("id") % 100 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("_flag"), F.lit("y").alias("_page"))
    gone = spark.range(0, 5000, 7).select(F.col("id").alias("doc_id"))
    out = without(df, gone)
    assert out.columns == df.columns and sorted(r.doc_id or -1 for r in out.collect()) == sorted(r.doc_id or -1 for r in df.collect() if r.doc_id is None or r.doc_id % 7)
    assert without(df, gone.limit(0)).count() == 5000 and without(df.limit(0), gone).count() == 0


def groups(nodes, links):
    """The groups of nodes that hang together by links, as sets."""
    label = {n: n for n in nodes}
    for a, b in links:
        x, y = label[a], label[b]
        label = {n: x if v == y else v for n, v in label.items()} if x != y else label
    return {frozenset(n for n in nodes if label[n] == v) for v in set(label.values())}


@pytest.mark.parametrize("rows_a_list", [1 << 15, 40])
def test_print_links_have_the_components_of_all_pairs(spark, monkeypatch, rows_a_list):
    """Dense balls, chains of three bits a step, copies and strays, in lists read whole and in blocks; links are few."""
    from roadlake.llm import simhash

    monkeypatch.setattr(simhash, "LIST", rows_a_list)
    rng = np.random.default_rng(21)
    flips = lambda k: sum(1 << int(b) for b in rng.choice(63, k, replace=False))
    prints = {0, -1, -2, -(1 << 63)}
    for _ in range(3):
        centre = int(rng.integers(0, 1 << 62))
        prints |= {centre ^ flips(int(rng.integers(0, 4))) for _ in range(120)} | {centre ^ flips(5) for _ in range(60)}
        step = centre
        for _ in range(20):
            step ^= flips(3)
            prints.add(step)
    rows = [(i, p) for i, p in enumerate(sorted(prints))] + [(1000 + i, 0) for i in range(50)]
    of = dict(rows)
    links = [tuple(r) for r in simhash.print_links(spark.createDataFrame(rows, "node long, fp long")).collect()]
    want = [(a, b) for a in of for b in of if a < b and bin((of[a] ^ of[b]) & ((1 << 64) - 1)).count("1") <= 3]
    assert groups(of, links) == groups(of, want) and len(groups(of, want)) > 100
    assert len(links) < 36 * len(rows) and len(want) > 5 * len(rows)


def test_a_dense_family_is_handed_on_with_few_links(spark, monkeypatch):
    """Near copies share many bands, each with a hub of its own; components get about one link a node."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    sets = [similar.shingles(" ".join(f"x{i}" if k == i % 120 else w for k, w in enumerate(base))) for i in range(300)]
    hashed = spark.createDataFrame([(similar.node_of(s), [int(b) for b in similar.bands_of(s)]) for s in sets], "node long, bands array<long>")
    given = []
    monkeypatch.setattr(similar, "components", lambda links: given.append(links) or components.components(links))
    got = similar.families(hashed).collect()
    assert given[0].count() < 600
    by_key = {}
    for r in hashed.collect():
        for b in r.bands:
            by_key.setdefault(b, []).append(r.node)
    label = {r.node: r.node for r in hashed.collect()}
    for nodes in by_key.values():
        met = {label[n] for n in nodes}
        label = {n: min(met) if k in met else k for n, k in label.items()}
    alone = {k for k in label.values() if list(label.values()).count(k) == 1}
    assert {(r.node, r.label) for r in got} == {(n, k) for n, k in label.items() if k not in alone}


def test_thinned_links_keep_components(spark):
    rng = random.Random(2)
    apart = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    dense = [(rng.randrange(100, 150), rng.randrange(100, 150)) for _ in range(800)]
    for rows in ([], [(7, 7)], apart, [*apart, *dense, *[(i, 1000) for i in range(100, 400)]]):
        links = spark.createDataFrame(rows, "a long, b long")
        fewer = components.thinned(links)
        assert fewer.count() <= links.filter("a <> b").distinct().count()
        assert sorted(components.components(fewer).collect()) == sorted(components.components(links).collect())
