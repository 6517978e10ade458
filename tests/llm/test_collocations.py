"""Collocations against plain counting and against SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from roadlake.llm import collocations as C

from .helpers import ROWS, docs, with_clashes


def plain(rows, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase of (text, lang) rows."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 10}
    out = {}
    for (lang, p), a in cand.items():
        if len(p) == 2 and any(100 * b >= 50 * a for (g, q), b in cand.items() if g == lang and len(q) == 3 and p in (q[:2], q[1:])):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for k, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def made(seed, n=150):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "of", "new", "york", "city", "éa", "ÉA", "a\x00b", "x-y", "to day", *[f"w{i}" for i in range(60)]]
    weights = 1 / np.arange(1, len(words) + 1)
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r", "!?", ";"]
    out = []
    for k in range(n):
        some = rng.choice(words, int(rng.integers(0, 200)), p=weights / weights.sum())
        out.append(("".join(str(w) + str(rng.choice(marks)) for w in some) + " new york city hall" * (k % 3), [None, "en", "fr", "und"][k % 4]))
    return out + [(None, "en"), ("", None), ("one two three", "xx"), ("rare pair " * 30, "xx")]


@pytest.mark.parametrize("head_words, head_pairs, tile, dense, chunk", [(1 << 18, 1 << 20, 1 << 10, 1 << 16, 1 << 20), (20, 15, 4, 10, 300), (0, 0, 4, 10, 300), (1000, 5, 8, 20, 2000)])
def test_equal_to_plain_counts(spark, monkeypatch, head_words, head_pairs, tile, dense, chunk):
    """With all addresses, few, none, and words only; with dense and sparse tiles; with a list that ends early."""
    for name, value in (("HEAD_WORDS", head_words), ("HEAD_PAIRS", head_pairs), ("TILE", tile), ("DENSE", dense), ("CHUNK", chunk)):
        monkeypatch.setattr(C, name, value)
    rows = made(head_words)
    df = with_clashes(docs(spark, [(i, t, g, "s", 1) for i, (t, g) in enumerate(rows)]).repartition(3))
    for top in (7, 10**6):
        got = sorted(map(tuple, C.collocations(df, top).collect()))
        assert got == plain(rows, top)
    assert len(got) > 100


def test_tiles():
    rng = np.random.default_rng(1)
    a, b = rng.zipf(1.3, 300_000) % 5000, rng.zipf(1.3, 300_000) % 3000
    got = {(x, y): n for x, y, n in zip(*(v.tolist() for v in C.tile_counts(a.astype(np.int64), b.astype(np.int64))))}
    assert got == Counter(zip(a.tolist(), b.tolist())) and sum(got.values()) == 300_000


def test_maps_hold_their_phrases(spark):
    phrases = [f"w{i} é{i}" for i in range(5000)]
    bits = C.map_of(spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    assert all(C._may_hold(bits, p.encode()) for p in phrases)
    assert sum(C._may_hold(bits, f"other{i}".encode()) for i in range(5000)) < 700


def test_large_counts_stay_exact(spark):
    """a * a * 1000000 and l * r beyond 64 bits."""
    big = 3_000_000_000_000_007
    df = spark.createDataFrame([(big, big + 11, big + 5)], "a long, l long, r long")
    got = df.selectExpr("(cast(a as decimal(18, 0)) * cast(a as decimal(18, 0)) * 1000000) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0))) as s").first().s
    assert got == 1000000 * big * big // ((big + 11) * (big + 5))


def test_awkward_rows(spark):
    assert C.collocations(docs(spark, [])).count() == 0
    rows = ROWS + [(50, "again and again " * 40, None, "s", 1)]
    got = sorted(map(tuple, C.collocations(with_clashes(docs(spark, rows))).collect()))
    assert got == plain([r[1:3] for r in rows], 2000) and got


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(C.SQL).fetchall()
    got = [tuple(r) for r in C.op12_tiled_collocations(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
