"""Classifiers: gradients, held-out accuracy, awkward rows; language fusion; the pipeline."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from roadlake.llm import byte_cnn, language_fusion, toxicity
from roadlake.llm.common import table

from .helpers import docs, with_clashes


def labelled(spark, sf, label, folds, held):
    d = f"/root/testdata/{sf}"
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", label).collect()
    part = lambda r: zlib.crc32(str(r.doc_id).encode()) % folds == held
    return [(r.text or "", r[label]) for r in rows if not part(r)], [(r.text or "", r[label]) for r in rows if part(r)]


def accuracy(scorer, rows, threshold, sigmoid):
    y = np.array([v for _, v in rows])
    hit = sigmoid(scorer.logits([t for t, _ in rows])) >= threshold
    return (hit == y).mean(), hit[y == 1].mean(), hit[y == 0].mean()


def test_toxicity_held_out(spark):
    train, test = labelled(spark, "sf0.1", "toxic", 3, 1)
    sample = [r for r in train if r[1] == 1] + [r for r in train if r[1] == 0][:900]
    net, bias = toxicity.fit(sample)
    right, recall, false = accuracy(toxicity.Scorer(net, bias), test, 0.7, toxicity.sigmoid)
    assert right > 0.96 and recall > 0.8 and false < 0.03


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = rng.standard_normal((4, 3, 6 * toxicity.HIDDEN)), np.ones((4, 3))
    mask[3, 1] = 0
    keep = []
    states, a, pooled, logit = net.read(x, mask, keep)
    g, dx = net.backward(x, mask, keep, states, a, pooled, np.ones(3))
    for name in ("uf", "ub", "att", "out"):
        at = tuple(rng.integers(0, s) for s in net.w[name].shape)
        old, out = net.w[name][at], []
        for step in (1e-2, -1e-2):
            net.w[name][at] = old + step
            out.append(net.read(x, mask)[3].sum())
        net.w[name][at] = old
        assert abs((out[0] - out[1]) / 2e-2 - g[name][at]) < 2e-3


def test_quality_held_out(spark):
    train, test = labelled(spark, "sf0.1", "quality", 5, 0)
    sample = [r for r in train if r[1] == 1][:400] + [r for r in train if r[1] == 0][:400]
    net, bias = byte_cnn.fit(sample)
    right, keep, _ = accuracy(byte_cnn.Scorer(net, bias), test, 0.3, byte_cnn.sigmoid)
    assert right > 0.95 and keep > 0.95


def test_chunks_cover_every_place():
    net, rng = byte_cnn.Network(2), np.random.default_rng(2)
    scorer = byte_cnn.Scorer(net, 0.0)
    texts = ["", "a", *["".join(map(chr, rng.integers(32, 127, n))) for n in (255, 256, 257, 70000)], "x" * 300]
    want = [net.head(byte_cnn.features(np.maximum(net.pooled(byte_cnn.chunks_of(t))[0], 0), np.array([0])))[1][0] for t in texts]
    assert np.allclose(scorer.logits(texts), want, atol=1e-4)


def plain_toxicity(net, bias, text):
    """The network of one text in double precision, word by word and window by window."""
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    words, h2 = toxicity.words_in(text), toxicity.HIDDEN
    total = []
    for s in toxicity.starts(len(words)):
        part = words[s : s + toxicity.WINDOW]
        x = []
        for word in part:
            rows, _ = toxicity.grams([word])
            x.append((w["word"][zlib.crc32(word) % toxicity.WORD_ROWS] + w["char"][rows].mean(axis=0)) @ w["x"] + w["bx"])
        states = np.zeros((len(part), 2 * h2))
        for side, u in ((0, w["uf"]), (1, w["ub"])):
            h = np.zeros(h2)
            for k in range(len(part)) if side == 0 else range(len(part) - 1, -1, -1):
                xi, hu = x[k][side * 3 * h2 : (side + 1) * 3 * h2], h @ u
                z, r = toxicity.sigmoid(xi[:h2] + hu[:h2]), toxicity.sigmoid(xi[h2 : 2 * h2] + hu[h2 : 2 * h2])
                n = np.tanh(xi[2 * h2 :] + r * hu[2 * h2 :])
                h = n + z * (h - n)
                states[k, side * h2 : (side + 1) * h2] = h
        a = np.exp(states @ w["att"])
        total.append(np.exp((a / a.sum()) @ states @ w["out"] + w["b"][0]) if part else np.exp(w["b"][0]))
    return np.log(np.mean(total)) + bias


def test_scorer_equals_a_plain_pass():
    rng = np.random.default_rng(6)
    net = toxicity.Network(3)
    net.w = {k: (v * 3).astype(np.float32) for k, v in net.w.items()}
    texts = ["", "one", "Two words!", *[" ".join(f"w{v}" for v in rng.integers(0, 300, n)) for n in (63, 64, 65, 112, 113, 700)]]
    got = toxicity.Scorer(net, 0.5).logits(texts)
    assert np.allclose(got, [plain_toxicity(net, 0.5, t) for t in texts], atol=2e-4)


@pytest.mark.parametrize("module", [toxicity, byte_cnn])
def test_a_score_does_not_depend_on_neighbours(module):
    """Bit for bit, in any batch and at any place, twenty times."""
    rng = np.random.default_rng(8)
    net = module.Network(3)
    text = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 5000, n))
    texts = [text(int(n)) for n in rng.integers(0, 400, 30)] + [""]
    alone = [module.Scorer(net, 0.1).logits([t])[0] for t in texts]
    for _ in range(20):
        scorer = module.Scorer(net, 0.1)
        order = rng.permutation(len(texts) * 2) % len(texts)
        mixed = [x for i in order for x in (text(int(rng.integers(0, 60))), texts[i])]
        got = scorer.logits(mixed)[1::2]
        assert all(g == alone[i] for g, i in zip(got, order))


@pytest.mark.parametrize("module", [toxicity, byte_cnn])
def test_awkward_rows(spark, module):
    df = with_clashes(docs(spark))
    sample = spark.createDataFrame([(1, "bad awful text " * 5, 1), (2, "nice good words " * 5, 0), (3, "", 0)], "doc_id long, text string, y int")
    rows = module.scored(df, sample, "p").collect()
    assert len(rows) == df.count() and all(0 <= r.p <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.text, set()).add(r.p)
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[""]
    assert module.scored(docs(spark, []), sample, "p").count() == 0
    assert {r.p for r in module.scored(df, sample.filter("y = 1"), "p").collect()} == {0.0}


def test_language_of_known_texts(spark):
    """Pages made of documents: the language is known."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    known = table(spark, d, "documents").filter("lang is not null")
    train = known.filter("doc_id % 2 = 0")
    pages = known.filter("doc_id % 2 = 1 and n_chars > 60").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.example/"), "doc_id").alias("url"), F.concat(F.lit("<html><body>"), "text").alias("html"), F.col("lang").alias("probability"))
    got = {r.page_id: r.lang for r in language_fusion.posterior(pages, train).collect()}
    want = {r.page_id: r.probability for r in pages.collect()}
    assert len(got) == len(want) and sum(got[k] == v for k, v in want.items()) > 0.97 * len(want)


def test_language_of_real_pages(spark):
    """The generated pages name their language in the path, which the operator does not read; with and without the declaration."""
    import re

    d = "/root/testdata/sf0.01"
    pages, train = table(spark, d, "pages"), table(spark, d, "documents")
    want = {r.page_id: re.search("://[^/]*/([a-z]+)/", r.url)[1] for r in pages.collect()}
    for html in ("html", """regexp_replace(html, 'lang="[a-z]+"', '')"""):
        rows = language_fusion.posterior(pages.selectExpr("page_id", "url", f"{html} as html"), train).collect()
        assert len(rows) == len(want) and sum(r.lang == want[r.page_id] for r in rows) >= 0.97 * len(want)


def test_fusion_by_plain_sums(spark):
    """Posteriors against the same rule in numpy, with each page taken out of the tables that speak about it."""
    rng = np.random.default_rng(12)
    vocabulary = {"de": "der die das und ist nicht ein auch".split(), "fr": "le la les des et pas une sur".split()}
    train = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary[lang], 12)), lang) for i, lang in enumerate(["de", "fr"] * 10)], "doc_id long, text string, lang string")
    hosts = ["a.co.uk", "b.co.uk", "x.a.de", "y.a.de", "b.fr", "b.fr", "lone.org", ""]
    rows = []
    for i in range(40):
        lang = ("de", "fr")[int(rng.integers(0, 2))]
        host, declared = hosts[int(rng.integers(0, len(hosts)))], ("", "de", "fr", "english")[int(rng.integers(0, 4))]
        words = " ".join(rng.choice(vocabulary[lang] + ["neutral"] * 8, int(rng.integers(0, 6))))
        rows.append((i, f"http://{host}/p" if host else None, f"<html lang={declared or '?'}>{words}</html>"))
    got = {r.page_id: (r.lang, r.probability) for r in language_fusion.posterior(spark.createDataFrame(rows, "page_id long, url string, html string"), train).collect()}
    langs, model = language_fusion.word_model(train)
    frame = spark.createDataFrame([(i, h.split(">", 1)[1].split("<")[0]) for i, _, h in rows], "i long, t string")
    buckets = {r.i: r.b for r in frame.select("i", language_fusion.buckets_of(frame["t"]).alias("b")).collect()}
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    ll, g, key = {}, {}, {}
    for i, url, html in rows:
        b = buckets[i]
        v = model[b].astype(float).sum(axis=0) * min(1.0, 40.0 / len(b)) if b else np.zeros(2)
        ll[i] = v - v.max()
        g[i] = soft(ll[i])
        host = url.split("/")[2] if url else ""
        parts = host.split(".")
        tail = 2 if len(parts) > 2 and parts[-2] == "co" else 1
        declared = html.split("=")[1].split(">")[0]
        key[i] = ("", ".".join(parts[-tail:]), ".".join(parts[-tail - 1 :]), host, declared if declared in ("de", "fr") else "")
    others = lambda i, level: sum((g[j] for j in g if j != i and key[j][level] == key[i][level]), np.zeros(2))
    for i, *_ in rows:
        prior = (others(i, 0) + 1) / (others(i, 0) + 1).sum()
        for level in (1, 2, 3):
            prior = (others(i, level) + 5 * prior) / (others(i, level) + 5 * prior).sum()
        log = ll[i] + np.log(prior)
        if key[i][4]:
            seen, all_ = others(i, 4), others(i, 0)
            log = log + np.log((seen + 5 * seen.sum() / all_.sum() + 1e-9) / (all_ + 5))
        p = soft(log)
        assert abs(got[i][1] - p.max()) < 1e-5 and (abs(p[0] - p[1]) < 1e-5 or got[i][0] == langs[int(p.argmax())])


def test_fusion_on_awkward_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "x", ""), (3, "http://a.b.fr/x", "<html lang='FR-fr'>"), (3, "http://a.b.fr/x", "<html lang='FR-fr'>"), (None, "http://c.de", "<p>der die das und ist nicht")], "page_id long, url string, html string")
    train = spark.createDataFrame([(1, "der die das und ist nicht ein", "de"), (2, "le la les des et pas une", "fr"), (3, None, None)], "doc_id long, text string, lang string")
    rows = language_fusion.posterior(pages, train).collect()
    assert len(rows) == 5 and all(r.lang in ("de", "fr") and 0 < r.probability <= 1 for r in rows)
    assert [r.lang for r in rows if r.page_id is None] == ["de"]
    assert language_fusion.posterior(pages, train.limit(0)).filter("lang is not null").count() == 0
    assert language_fusion.posterior(pages.limit(0), train).count() == 0


def test_pipeline_stages_take_effect(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == columns
        before, after = {r.doc_id for r in df.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before
        if name == "secrets":
            assert after == before
        if name == "near_duplicates":
            from roadlake.llm import similar

            assert after == {r.component_id for r in similar.similar_groups(df).collect()}
        if name == "decontamination":
            from roadlake.llm import decontaminate

            hit = {r.doc_id for r in decontaminate.leaks(df, table(spark, sf_dir, "benchmark")).collect()}
            assert after == before - hit
        df = spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, df, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in df.collect()}


def run_over(spark, path, rows):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some other passage that occurs in no document at all today")], "item_id long, text string")
    for name, df in (("documents", rows), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{path}/{name}.parquet")
    return corpus_pipeline.run(spark, str(path))


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats and clashing columns: every kept document is packed whole; an empty table gives none."""
    rows = with_clashes(docs(spark)).filter("doc_id is null or doc_id <> 8")
    out = run_over(spark, tmp_path / "some", rows).collect()
    # 1 and 2 are copies, 3, 4 and 7 have no words and the two rows of 5 are one text; null ids stay.
    kept = {r.doc_id for r in out}
    assert kept <= {1, 3, 5, 9, None} and {3, None} <= kept
    for d in kept - {None}:
        mine = sorted((r.start, r.length, r.doc_tokens) for r in out if r.doc_id == d)
        assert [a for a, _, _ in mine] == [sum(n for _, n, _ in mine[:k]) for k in range(len(mine))] and sum(n for _, n, _ in mine) == mine[0][2]
    assert run_over(spark, tmp_path / "none", rows.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_of_any_name(spark, tmp_path, name, stage):
    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "the cat and the dog sat on the mat in the house")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    df = with_clashes(docs(spark)).withColumns({c: F.lit("x") for c in ("_flag", "_gone", "_page", "_bits", "_place", "row", "node", "label", "h")})
    out = stage(spark, df, d)
    assert out.columns == df.columns and 0 < out.count() <= df.count()
    assert stage(spark, df.limit(0), d).count() == 0
