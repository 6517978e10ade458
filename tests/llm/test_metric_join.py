"""The metric range join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlake.llm import metric_join as M

SCHEMA = "vec_id long, embedding array<float>, label int, node string, cell string, copies string"


def brute(rows, least):
    """(n_links, component_id) of each row, by all pairs of float rows in double precision."""
    def unit(e):
        if e is None or not len(e) or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            return None
        x = np.array(e, np.float32).astype(float)
        return x / np.linalg.norm(x)

    xs = [None if r[2] is None else unit(r[1]) for r in rows]
    near = [[j for j in range(len(rows)) if j != i and x is not None and xs[j] is not None and rows[i][2] == rows[j][2] and len(x) == len(xs[j]) and x @ xs[j] >= least] for i, x in enumerate(xs)]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp[i] = min(ids) if ids else None
    return sorted(((r[0], len(n), c, r[0] == c) for r, n, c in zip(rows, near, comp)), key=repr)


def made(seed, n=260, dim=6):
    """Clusters tight and loose, a chain along an arc, random vectors, scaled copies and exact copies, over two labels."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        kind = k % 5
        centre = np.random.default_rng(k % 3).standard_normal(dim)
        e = [centre + 0.05 * rng.standard_normal(dim), centre + 0.4 * rng.standard_normal(dim), rng.standard_normal(dim), 3 * centre, None][kind]
        if e is None:
            angle = 0.15 * (k // 5)
            e = np.array([np.cos(angle), np.sin(angle)] + [0.0] * (dim - 2))
        out.append((k, [float(x) for x in e.astype(np.float32)], k % 2, "x", "y", "z"))
    return out


AWKWARD = [
    (1000, None, 0), (1001, [], 0), (1002, [0.0] * 6, 0), (1003, [float("nan")] * 6, 0), (1004, [float("inf")] + [1.0] * 5, 0), (1005, [None] + [1.0] * 5, 0),
    (1006, [1.0] * 6, None), (1007, [1.0] * 6, 5), (1007, [1.0] * 6, 5), (None, [1.0] * 6, 5), (None, [2.0] * 6, 6), (1008, [1.0] * 5, 5), (1009, [3e38] * 6, 5), (1010, [1e-40] * 6, 5),
]


@pytest.mark.parametrize("leaf, least, block", [(8, 0.98, 1 << 20), (8, 0.9, 24 * 48), (1000, 0.98, 10 * 48)])
def test_equal_to_all_pairs(spark, monkeypatch, leaf, least, block):
    monkeypatch.setattr(M, "LEAF", leaf)
    monkeypatch.setattr(M, "BLOCK_BYTES", block)
    monkeypatch.setattr(M, "PART_ROWS", 30)
    rows = made(leaf) + [(*r, "x", "y", "z") for r in AWKWARD]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in M.near_vectors(spark.createDataFrame(rows, SCHEMA), least).collect()), key=repr)
    want = brute(rows, least)
    assert got == want
    assert len({w[2] for w in want}) > 20 and max(w[1] for w in want) > 10


def test_parts_leave_clusters_apart_and_do_not_multiply(spark, monkeypatch):
    """Tight clusters get parts without copies; vectors without structure stay one part."""
    monkeypatch.setattr(M, "LEAF", 50)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((4, 64))
    x = np.concatenate([c + 0.05 * rng.standard_normal((150, 64)) for c in centres] + [rng.standard_normal((200, 64))])
    rows = spark.createDataFrame([("0", i, True, 1, [float(v) for v in r]) for i, r in enumerate(x)], "cell string, node long, home boolean, copies long, vector array<float>")
    parts = M.parts_of(rows, 0.2).cache()
    assert parts.filter("home").count() == parts.filter("home").select("node").distinct().count() == len(x)
    assert parts.count() < 1.2 * len(x)
    homes = {r.node: r.cell for r in parts.filter("home").collect()}
    of_cluster = [{homes[i] for i in range(150 * k, 150 * k + 150)} for k in range(4)]
    assert all(len(c) == 1 for c in of_cluster) and len(set.union(*of_cluster)) == 4
    assert not parts.filter(F.col("home") == F.lit(False)).filter(F.col("cell").isin(list(set.union(*of_cluster)))).count()


def test_empty_table(spark):
    assert M.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
