"""Source divergence against plain sums and against SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from roadlake.llm import divergence as D

from .helpers import ROWS, docs, with_clashes


def plain(rows, least_docs, top):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    n, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        ts = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[lang, source].update(ts)
        held[lang].update(set(ts))
    out = []
    for lang, source in groups:
        kept = [t for t, k in held[lang].items() if k >= least_docs]
        share = lambda c, total: 1 + 1000000000 * (c + 5) // (total + 5 * len(kept))
        of = lambda s: (lambda total: {t: share(n[lang, s][t], total) for t in kept})(sum(n[lang, s][t] for t in kept))
        own = of(source)
        pairs = [(-sum(abs(own[t] - o[t]) for t in kept), s.encode()) for g, s in groups if g == lang and s != source for o in [of(s)]]
        every = Counter()
        for g, s in groups:
            if g == lang:
                every.update(n[g, s])
        total = sum(every[t] for t in kept)
        over = [(-(own[t] - share(every[t], total)), t.encode()) for t in kept if n[lang, source][t] and own[t] > share(every[t], total)]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
            out += [(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def made(seed, sources, n=400):
    rng = np.random.default_rng(seed)
    words = ["The", "É", "éa", "x-y", "don't", "1a2", "ＡＢ", "a\x00b", *[f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]]
    weights = 1 / np.arange(1, len(words) + 1) ** 1.5
    out = []
    for k in range(n):
        source, lang = int(rng.zipf(1.3)) % sources, [None, "en", "fr", ""][k % 4]
        order = np.roll(np.arange(len(words)), source % 5)
        out.append((" ".join(words[order[i]] for i in rng.choice(len(words), int(rng.integers(0, 60)), p=weights / weights.sum())), lang, None if source == 3 else f"s{source}é"))
    return out + [(None, "en", "empty"), ("never often", "xx", "a"), ("", "xx", "b"), ("one source only", "yy", "z")]


@pytest.mark.parametrize("sources, side, leaf, stripe, least", [(12, 256, 8, 4096, 3), (45, 8, 2, 32, 1), (45, 16, 4, 16, 5), (9, 16, 8, 64, 30)])
def test_equal_to_plain_sums(spark, monkeypatch, sources, side, leaf, stripe, least):
    """One block and many, in rows and columns."""
    for name, value in (("SIDE", side), ("LEAF", leaf), ("STRIPE", stripe), ("CELLS", 1 << 10)):
        monkeypatch.setattr(D, name, value)
    rows = made(sources, sources)
    df = with_clashes(docs(spark, [(i, t, g, s, 1) for i, (t, g, s) in enumerate(rows)]).repartition(3))
    got = sorted(map(tuple, D.divergence(df, least, 20).collect()))
    assert got == plain(rows, least, 20) and len(got) > 300


def test_empty_quadrants_are_priced_without_visits(monkeypatch):
    """Of a block with one occupied corner only its leaves are compared."""
    seen = []
    monkeypatch.setattr(D.np, "abs", lambda x, real=np.abs: (seen.append(x.size), real(x))[1])
    a = np.zeros((D.SIDE, D.SIDE), np.int64)
    a[:8, :8] = 5
    total, blank = np.zeros_like(a), [np.zeros((D.SIDE >> k, D.SIDE >> k), np.int64) for k in range(D.SIDE.bit_length())]
    D.walked(a, a, np.ones(D.SIDE, np.int64), np.ones(D.SIDE, np.int64), (D.SIDE, D.SIDE), False, total, blank)
    assert sum(seen) == (2 * D.SIDE // 8 - 1) * 8**3
    assert total[0, 100] == total[100, 0] == 8 * 4 and total[0, 1] == total[100, 101] == 0


def test_shares_beyond_64_bits(spark):
    n = 3_000_000_000_000_017
    got = spark.createDataFrame([(n, 3 * n, 1000)], "n long, own long, v long").select(D.share("n", "own", "v").alias("p")).first().p
    assert got == 1 + 1000000000 * (n + 5) // (3 * n + 5000)


def test_awkward_rows(spark):
    assert D.divergence(docs(spark, [])).count() == 0
    got = sorted(map(tuple, D.divergence(with_clashes(docs(spark)), 1, 50).collect()))
    assert got == plain([(r[1], r[2], r[3]) for r in ROWS], 1, 50)


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(D.SQL).fetchall()
    got = [tuple(r) for r in D.op13_quadtree_divergence(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
