"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of a hashed word vector and the mean of its hashed
character-gram vectors (with marks for its ends). Overlapping windows of WINDOW
words, STRIDE apart, cover the whole text; each is read in both directions,
attention pools the states to one logit, and the document's logit is the log of
the mean of exp over its windows. Fitted by backpropagation in one task on at
most PER_CLASS labelled documents of each class, out of the training folds only;
each pass reads at most TRAIN_WINDOWS windows of a training text, drawn anew.
Scoring reads all windows. Labels, language, source and doc_id are not inputs.

A text's score does not depend on its neighbours. A row of a BLAS product does
depend on its place in the block, even at one shape, so scoring uses none: the
products with the small weights are sums of elementwise ones, term by term, over
feature-major arrays (`product`), and all other sums run along one text.
Training, which fixes the order of its rows, keeps the matrix products.

Defined results: a null or wordless text has one empty window, whose score is
that of no evidence; repeated rows get equal scores; without usable labels of
both classes the score is 0; an empty table gives no rows; other columns are
ignored. Memory in a worker: one Arrow batch, ROWS windows at a time, and a
word table of CACHE entries.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .labelled import Adam, bias_for, epochs_for, fitted, fold, scatter_add, sigmoid, training_sample

WINDOW, STRIDE = 64, 48
DIM, HIDDEN = 16, 8
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 13
PER_CLASS = 1200
TRAIN_WINDOWS = 5
EPOCHS, BATCH, RATE = 6, 48, 0.01
LEAST_STEPS = 200
THRESHOLD = 0.7
CACHE, ROWS = 150_000, 1024
FOLDS, HELD = 3, 1
_CLEAN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_in(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_CLEAN).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character grams of three to five bytes, ends marked, of all words in turn, and how many each has.

    An empty word counts as its two marks with one gram.
    """
    data = np.frombuffer(b"".join(b"<" + (w or b"\0") + b">" for w in words), np.uint8).astype(np.uint32)
    size = np.array([max(1, len(w)) + 2 for w in words])
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes to the word's end
    rolled, out, owner = data.copy(), [], []
    for n in range(2, 6):
        if len(data) < n:
            break
        rolled = rolled[:-1] * np.uint32(0x01000193) ^ data[n - 1 :]
        if n > 2:
            at = np.flatnonzero(left[: len(rolled)] >= n)
            h = rolled[at] * np.uint32(0x9E3779B1) + np.uint32(n)
            out.append((h >> np.uint32(16)) % np.uint32(CHAR_ROWS))
            owner.append(at)
    where = np.concatenate(owner)
    order = np.argsort(where, kind="stable")
    word = np.repeat(np.arange(len(words)), size)[where[order]]
    return np.concatenate(out)[order].astype(np.int64), np.bincount(word, minlength=len(words))


def mean_rows(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None].astype(np.float32)


def starts(n: int) -> list[int]:
    """First words of the windows of n words; the last window ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def product(u: np.ndarray, h: np.ndarray) -> np.ndarray:
    """u.T @ h for a small u (k, n) and h (k, m): summed in the order of k for each column of h, wherever it stands."""
    out = u[0][:, None] * h[0]
    term = np.empty_like(out)
    for weights, row in zip(u[1:], h[1:]):
        out += np.multiply(weights[:, None], row, out=term)
    return out


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.w = {
            "word": f(WORD_ROWS, DIM, scale=0.1), "char": f(CHAR_ROWS, DIM, scale=0.1),
            "x": f(DIM, 6 * HIDDEN, scale=0.3), "bx": np.zeros(6 * HIDDEN, np.float32),
            "uf": f(HIDDEN, 3 * HIDDEN, scale=0.3), "ub": f(HIDDEN, 3 * HIDDEN, scale=0.3),
            "att": f(2 * HIDDEN, scale=0.3), "out": f(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32),
        }

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """The input vector of each word."""
        rows, sizes = grams(words)
        return self.w["word"][[zlib.crc32(w) % WORD_ROWS for w in words]] + mean_rows(self.w["char"][rows], sizes)

    def read(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """States (T, m, 2H), attention (T, m), pooled (m, 2H) and logits of projected inputs x (T, m, 6H), for training."""
        t, m, _ = x.shape
        h2 = HIDDEN
        states = np.empty((t, m, 2 * h2), np.float32)
        for side, name in ((0, "uf"), (1, "ub")):
            h, u = np.zeros((m, h2), np.float32), self.w[name]
            for k in range(t) if side == 0 else range(t - 1, -1, -1):
                xi = x[k, :, side * 3 * h2 : (side + 1) * 3 * h2]
                hu = h @ u
                zr = xi[:, : 2 * h2] + hu[:, : 2 * h2]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :h2], zr[:, h2:]
                n = np.tanh(xi[:, 2 * h2 :] + r * hu[:, 2 * h2 :])
                new = (n + z * (h - n)) * mask[k][:, None]
                if keep is not None:
                    keep.append((side, k, h, z.copy(), r.copy(), n, hu[:, 2 * h2 :].copy()))
                h = new
                states[k, :, side * h2 : (side + 1) * h2] = h
        a = (states * self.w["att"]).sum(axis=2)
        a = np.exp(np.clip(a, -30, 30)) * mask
        a /= a.sum(axis=0) + 1e-9
        pooled = (a[:, :, None] * states).sum(axis=0)
        return states, a, pooled, (pooled * self.w["out"]).sum(axis=1) + self.w["b"]

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The logits that `read` gives, each free of its place among the others: x is (T, 6H, m)."""
        t, _, m = x.shape
        h2 = HIDDEN
        states = np.empty((t, 2 * h2, m), np.float32)
        for side, name in ((0, "uf"), (1, "ub")):
            h = np.zeros((h2, m), np.float32)
            for k in range(t) if side == 0 else range(t - 1, -1, -1):
                xi = x[k, side * 3 * h2 : (side + 1) * 3 * h2]
                hu = product(self.w[name], h)
                zr = xi[: 2 * h2] + hu[: 2 * h2]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                n = np.tanh(xi[2 * h2 :] + zr[h2:] * hu[2 * h2 :])
                h = (n + zr[:h2] * (h - n)) * mask[k]
                states[k, side * h2 : (side + 1) * h2] = h
        a = np.stack([product(self.w["att"][:, None], s)[0] for s in states])
        a = np.exp(np.clip(a, -30, 30)) * mask
        total, pooled = np.zeros(m, np.float32), np.zeros((2 * h2, m), np.float32)
        for weight, state in zip(a, states):
            total += weight
            pooled += weight * state
        return product(self.w["out"][:, None], pooled)[0] / (total + np.float32(1e-9)) + self.w["b"]

    def backward(self, x: np.ndarray, mask: np.ndarray, keep: list, states, a, pooled, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        h2 = HIDDEN
        g = {"out": pooled.T @ dlogit, "b": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * self.w["out"]
        da = np.einsum("mh,tmh->tm", dpool, states)
        ds = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("tm,tmh->h", ds, states)
        dstates = a[:, :, None] * dpool + ds[:, :, None] * self.w["att"]
        dx = np.zeros_like(x)
        for name in ("uf", "ub"):
            g[name] = np.zeros_like(self.w[name])
        dh = {0: np.zeros_like(dpool[:, :h2]), 1: np.zeros_like(dpool[:, :h2])}
        for side, k, h, z, r, n, hn in reversed(keep):
            u, name = (self.w["uf"], "uf") if side == 0 else (self.w["ub"], "ub")
            d = (dh[side] + dstates[k, :, side * h2 : (side + 1) * h2]) * mask[k][:, None]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            dhu = np.concatenate([dz, dr, dn * r], axis=1)
            dx[k, :, side * 3 * h2 : (side + 1) * 3 * h2] = np.concatenate([dz, dr, dn], axis=1)
            g[name] += h.T @ dhu
            dh[side] = d * z + dhu @ u.T
        return g, dx


def _windows(words: list[bytes], limit: int | None, rng) -> list[list[bytes]]:
    at = starts(len(words))
    if limit and len(at) > limit:
        at = [at[i] for i in rng.choice(len(at), limit, replace=False)]
    return [words[s : s + WINDOW] for s in at]


def fit(sample: list[tuple[str, int]], epochs: int | None = None, seed: int = 7) -> tuple[Network, float] | None:
    """Network and bias, by Adam on the documents' logits; None without both classes."""
    if len({y for _, y in sample}) < 2:
        return None
    epochs = epochs or epochs_for(len(sample), EPOCHS, BATCH, LEAST_STEPS)
    rng, net = np.random.default_rng(seed), Network(seed)
    docs = [(words_in(t), y) for t, y in sample]
    y_all = np.array([y for _, y in docs])
    weight = {1: 0.5 / y_all.mean(), 0: 0.5 / (1 - y_all.mean())}
    adam = Adam(net.w, RATE)
    known: dict[bytes, int] = {}
    for ws, _ in docs:
        for w in ws:
            known.setdefault(w, len(known))
    vocabulary = list(known) or [b""]
    hashed = np.array([zlib.crc32(w) % WORD_ROWS for w in vocabulary])
    gram_rows, gram_sizes = grams(vocabulary)
    gram_first = np.concatenate([[0], np.cumsum(gram_sizes)[:-1]])
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / (epochs + 1))
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            wins, owner = [], []
            for d, i in enumerate(order[k : k + BATCH]):
                for w in _windows(docs[i][0], TRAIN_WINDOWS, rng):
                    wins.append([known[v] for v in w])
                    owner.append(d)
            owner = np.array(owner)
            t, m = max(1, max(map(len, wins))), len(wins)
            idx, mask = np.zeros((t, m), np.int64), np.zeros((t, m), np.float32)
            for j, w in enumerate(wins):
                idx[: len(w), j] = w
                mask[: len(w), j] = 1
            used, inv = np.unique(idx, return_inverse=True)
            sizes = gram_sizes[used]
            flat = gram_rows[np.repeat(gram_first[used] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            vec = net.w["word"][hashed[used]] + mean_rows(net.w["char"][flat], sizes)
            proj = vec @ net.w["x"] + net.w["bx"]
            x = proj[inv.reshape(t, m)]
            keep: list = []
            states, a, pooled, logit = net.read(x, mask, keep)
            y = y_all[order[k : k + BATCH]]
            n_docs, counts = len(y), np.bincount(owner, minlength=len(y))
            e = np.exp(np.clip(logit, -30, 30))
            total = np.bincount(owner, weights=e, minlength=n_docs)
            doc = np.log(total / counts)
            ddoc = (sigmoid(doc) - y) * np.where(y == 1, weight[1], weight[0]) / n_docs
            dlogit = (ddoc[owner] * e / total[owner]).astype(np.float32)
            g, dx = net.backward(x, mask, keep, states, a, pooled, dlogit)
            dproj = scatter_add(len(proj), inv.reshape(-1), dx.reshape(-1, dx.shape[-1]))
            g["x"], g["bx"] = vec.T @ dproj, dproj.sum(axis=0)
            dvec = dproj @ net.w["x"].T
            g["word"] = scatter_add(WORD_ROWS, hashed[used], dvec)
            g["char"] = scatter_add(CHAR_ROWS, flat, np.repeat(dvec / sizes[:, None], sizes, axis=0))
            adam.step(g)
    scorer = Scorer(net, 0.0)
    logits = np.concatenate([scorer.logits([t for t, _ in sample[k : k + 500]]) for k in range(0, len(sample), 500)])
    return net, bias_for(logits, y_all, THRESHOLD)


class Scorer:
    """Logits of whole texts; words new to the table are projected once. Row 0 of the table is padding."""

    def __init__(self, net: Network, bias: float):
        self.net, self.bias = net, bias
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.proj = np.zeros((1 << 12, 6 * HIDDEN), np.float32)

    def __getstate__(self):
        return {"net": self.net, "bias": self.bias}

    def __setstate__(self, state):
        self.net, self.bias = state["net"], state["bias"]
        self._clear()

    def add(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.rows]
        at = len(self.rows) + 1
        if not new:
            return
        while len(self.proj) < at + len(new):
            self.proj = np.concatenate([self.proj, np.zeros_like(self.proj)])
        vectors = np.ascontiguousarray(self.net.vectors(new).T)
        self.proj[at : at + len(new)] = product(self.net.w["x"], vectors).T + self.net.w["bx"]
        self.rows.update(zip(new, range(at, at + len(new))))

    def logits(self, texts: list[str]) -> np.ndarray:
        total, counts = np.zeros(len(texts)), np.zeros(len(texts))
        parts: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            size = np.array([len(c) for _, c in parts])
            t = max(1, int(size.max()))
            idx = np.zeros((len(parts), t), np.int64)
            for j, (_, c) in enumerate(parts):
                idx[j, : len(c)] = c
            mask = (np.arange(t)[:, None] < size).astype(np.float32)
            x = np.stack([np.ascontiguousarray(self.proj[column].T) for column in idx.T])
            logit = self.net.scores(x, mask)
            owner = np.array([d for d, _ in parts])
            np.add.at(total, owner, np.exp(np.clip(logit, -30, 30)))
            np.add.at(counts, owner, 1)
            parts.clear()

        for k in range(0, len(texts), 100):
            some = [words_in(t) for t in texts[k : k + 100]]
            if len(self.rows) > CACHE:
                if parts:
                    flush()
                self._clear()
            self.add(set().union(*some))
            for d, words in enumerate(some, k):
                codes = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
                for s in starts(len(codes)):
                    parts.append((d, codes[s : s + WINDOW]))
                    if len(parts) == ROWS:
                        flush()
        if parts:
            flush()
        return np.log(total / counts) + self.bias


def scored(docs: DataFrame, sample: DataFrame, name: str = "score") -> DataFrame:
    """docs with the column `name`, from a network fitted on the sample (doc_id, text, y)."""
    model = fitted(sample, fit)
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(*model))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value
        for texts in batches:
            values = texts.tolist()
            yield pd.Series(np.concatenate([sigmoid(scorer.logits(values[k : k + 1000])) for k in range(0, len(values), 1000)]) if values else [], dtype="float64")

    return docs.withColumn(name, run(text_of()))


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return training_sample(docs, labels, "toxic", FOLDS, HELD, PER_CLASS)


def op3_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, sample_of(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
