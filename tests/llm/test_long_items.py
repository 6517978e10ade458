"""Decontamination at the full bound of edits on long items."""

import numpy as np

from roadlake.llm import decontaminate

from .helpers import docs


def test_every_copy_at_the_bound_is_found(spark):
    """20 per cent of the words edited, by changes or by an insertion and a deletion in turn; one edit more is clean."""
    rng = np.random.default_rng(9)
    fresh = iter(f"x{i}" for i in range(10**6))
    items, rows, want = [], [], {}
    for i, n in enumerate([20, 50, 100, 100, 200, 200, 200, 300]):
        own = [f"i{i}w{k}" for k in range(n)]
        items.append((i, " ".join(own)))
        for kind in ("change", "move", "over"):
            copy, e = list(own), n // 5
            if kind == "move":
                for at in sorted(rng.choice(np.arange(1, n - 1), e // 2, replace=False).tolist(), reverse=True):
                    copy.insert(at, next(fresh))
                    del copy[int(rng.integers(at + 1, len(copy) - 1)) if at + 1 < len(copy) - 1 else at]
            else:
                for at in rng.choice(np.arange(n), e + (kind == "over"), replace=False):
                    copy[at] = next(fresh)
            d = len(rows)
            rows.append((d, " ".join([*(next(fresh) for _ in range(40)), *copy, *(next(fresh) for _ in range(40))]), "en", "s", 1))
            if kind != "over":
                want[d, i] = e
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert set(got) == set(want) and all(got[k] <= want[k] for k in want)


def brute(codes, item, edits):
    """Least (edits, start) of the item's windows in the text, over all windows; None beyond `edits`."""
    n = len(item)
    starts = range(max(1, len(codes) - n + 1))
    windows = np.full((len(starts), n), -1, np.int64)
    for k in starts:
        part = codes[k : k + n]
        windows[k, : len(part)] = part
    size = np.array([min(n, len(codes) - k) for k in starts])
    found = decontaminate.edit_distance(windows, size, np.tile(item, (len(starts), 1)), np.full(len(starts), n))
    k = int(found.argmin())
    return (int(found[k]), k) if found[k] <= edits else None


def test_recall_by_length_against_all_windows():
    """Texts with copies at exactly 20 per cent edits, by each kind of edit, against the search of every window."""
    rng = np.random.default_rng(11)
    for n in (20, 60, 100, 150, 200, 300):
        e, hits, near, wrong = n // 5, 0, 0, 0
        items = [(i, " ".join(f"w{v}" for v in rng.integers(i * 1000, i * 1000 + 400, n))) for i in range(4)]
        index = decontaminate.ItemIndex(items, 0.8)
        for trial in range(24):
            k, kind = trial % 4, ("change", "move", "both")[trial % 3]
            copy = decontaminate.edited(index.rows[k], e, kind, rng, 10**6)
            noise = lambda: rng.integers(2 * 10**6, 3 * 10**6, 30)
            text = np.concatenate([noise(), copy[copy > 0], noise()])
            codes = np.where(text < index.base, text, 0)
            got = index.match([(0, codes, i, s, least) for i, s, least in index.windows(codes)])
            want = {i: b for i in range(4) if (b := brute(np.where(codes > 0, codes, -9), index.rows[i], int(index.edits[i]))) is not None}
            near += len(want)
            hits += sum((0, i) in got for i in want)
            wrong += sum(i not in want for _, i in got)
        assert near >= 18 and hits >= 0.95 * near and not wrong, (n, near, hits, wrong)


def test_very_long_and_repeated_items(spark):
    """One item of 20,000 words beside many short ones and 3,000 rows of one text."""
    long = [f"w{i}" for i in range(20000)]
    copy = ["new"] * 5 + long[:7000] + ["x"] + long[7001:] + ["end"] * 5
    same = "a passage of benchmark words that many rows of it repeat"
    items = [(1, " ".join(long)), *[(10 + i, f"item {i} has its own few words and number {i}") for i in range(200)], *[(1000 + i, same) for i in range(3000)], (None, same)]
    rows = [(1, " ".join(copy), "en", "s", 1), (2, f"see {same} here", "en", "s", 1), (3, "clean text", "en", "s", 1)]
    got = decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block=40).collect()
    assert [(r.item_id, r.start, r.edits) for r in got if r.doc_id == 1] == [(1, 5, 1)]
    assert sorted(r.item_id for r in got if r.doc_id == 2 and r.item_id) == list(range(1000, 4000)) and sum(r.item_id is None for r in got) == 1
    assert not [r for r in got if r.doc_id == 3]
