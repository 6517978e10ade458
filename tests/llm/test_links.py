"""Near-duplicates, components and decontamination against brute force."""

import re

import numpy as np
import xxhash

from roadlake.llm import decontaminate, simhash
from roadlake.llm.common import table
from roadlake.llm.components import components

from .helpers import docs, saved, with_clashes


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


def groups(prints, ids):
    """Least id of each row's component by all pairs."""
    a, label = np.array(prints, np.uint64), list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = root(i), root(int(j))
            label[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        k = root(i)
        if d is not None:
            least[k] = min(d, least.get(k, d))
    return [least.get(root(i)) for i in range(len(a))]


def check(rows, given):
    texts = {}
    for r in given:
        texts.setdefault(str(r.doc_id), r.text or "")
    prints = [fingerprint(texts[str(r.doc_id)]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in rows] == groups(prints, [r.doc_id for r in rows])


def test_simhash(spark, sf_dir, tmp_path):
    check(simhash.op8_simhash_pigeonring(spark, sf_dir).collect(), table(spark, sf_dir, "documents").collect())
    small = with_clashes(docs(spark))
    check(simhash.op8_simhash_pigeonring(spark, saved(spark, tmp_path, documents=small)).collect(), small.collect())
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_candidates_lose_no_link(spark):
    """Random fingerprints with planted neighbours at one to four bits."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, k, replace=False)) for b in base for k in (1, 2, 3, 4)]
    every = sorted({*map(int, base), *near, 0, -1, -2, -(1 << 63)})
    got = {(r.a, r.b) for r in simhash.candidate_links(spark.createDataFrame([(v,) for v in every], "fp long")).collect()}
    want = {(x, y) for i, x in enumerate(every) for y in every[i + 1 :] if bin((x ^ y) & ((1 << 64) - 1)).count("1") <= 3}
    assert got == want and len(want) > 150


def test_one_of_each(spark):
    df = with_clashes(docs(spark))
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "5", "8", "9", "None"]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[200] == 100


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, (50, 9)), rng.integers(0, 5, (50, 12))
    la, lb = rng.integers(0, 10, 50), rng.integers(0, 13, 50)
    a[np.arange(9) >= la[:, None]] = -1
    b[np.arange(12) >= lb[:, None]] = -2
    got = decontaminate.edit_distance(a, la, b, lb)
    assert got.tolist() == [brute_edits(a[i, : la[i]].tolist(), b[i, : lb[i]].tolist()) for i in range(50)]


def test_planted_passages(spark):
    """Every edited copy within the bound is found, with few missed by chance; clean texts are not."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 400)}"
    items = [(i, " ".join(word() for _ in range(rng.integers(20, 60)))) for i in range(30)]
    rows, planted = [], set()
    for d in range(120):
        text = [word() for _ in range(200)]
        if d % 2:
            i = int(rng.integers(0, 30))
            copy = items[i][1].split()
            for _ in range(rng.integers(0, max(1, int(0.15 * len(copy))))):
                at, kind = rng.integers(0, len(copy)), rng.integers(0, 3)
                copy[at : at + 1] = [[word()], [], [copy[at], word()]][kind]
            text[50:50] = copy
            planted.add((d, i))
        rows.append((d, " ".join(text), "en", "s", 1))
    bench = spark.createDataFrame(items + [(99, None), (98, "too short"), (97, items[0][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(with_clashes(docs(spark, rows)), bench).collect()}
    assert {d for d, _ in got} <= {d for d, _ in planted}
    assert len(planted - got) <= 0.03 * len(planted)


def test_leaks_on_awkward_rows(spark):
    bench = spark.createDataFrame([(1, docs(spark).first().text)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.edits) for r in decontaminate.leaks(docs(spark), bench).collect())
    assert got == [(1, 1, 0, 0), (2, 1, 0, 0)]
    kept = decontaminate.without_leaks(with_clashes(docs(spark)), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "5", "7", "8", "9", "None"]
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0 and decontaminate.leaks(docs(spark), bench.limit(0)).count() == 0


def test_short_items_are_looked_up(spark):
    """Items of one to four words match as they stand; the filter leaves them out unless told not to."""
    rows = [(1, "alpha beta, gamma delta and more alpha", "en", "s", 1), (2, "beta alpha", "en", "s", 1), (3, "nothing", "en", "s", 1), (4, "delta", "en", "s", 1)]
    bench = spark.createDataFrame([(1, "Alpha"), (2, "beta gamma"), (3, "alpha beta gamma delta"), (4, "beta gamma alpha"), (5, "..."), (6, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.words, r.edits) for r in decontaminate.leaks(docs(spark, rows), bench).collect())
    assert got == [(1, 1, 0, 1, 0), (1, 2, 1, 2, 0), (1, 3, 0, 4, 0), (2, 1, 1, 1, 0)]
    assert decontaminate.without_leaks(docs(spark, rows), bench).count() == 4
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs(spark, rows), bench, 1).collect()) == [3, 4]


def test_leaks_by_row_not_by_id(spark):
    """Of several texts of one id, or of none, only contaminated ones go; copies of a row go together."""
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(1, f"before {item} after"), (1, "a clean text of the same id"), (None, f"{item} without an id"), (None, "clean without an id"), (2, item), (2, item), (3, "clean"), (3, "clean")]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = decontaminate.without_leaks(with_clashes(docs(spark, [(d, t, "en", "s", 1) for d, t in rows])), bench)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", rows[1][1]), ("None", rows[3][1]), ("3", "clean"), ("3", "clean")])
