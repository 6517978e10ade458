"""Quality: a byte-level convolutional network in numpy over overlapping chunks.

FILTERS filters of WIDTH bytes are learned as one table per place (byte value to
filter weights), so a convolution is a sum of look-ups; for scoring, tables of
neighbouring places are joined to one per byte pair. Chunks of CHUNK bytes
overlap by WIDTH - 1 bytes, so every place of the whole text is covered once;
each filter is rectified and max-pooled within a chunk, and the mean and the
maximum over chunks feed a hidden layer and one logit. Fitted by
backpropagation in one task on at most PER_CLASS labelled documents of each
class, of the training folds only; each pass reads at most TRAIN_CHUNKS chunks
of a training text, drawn anew. Scoring reads all chunks, and a text's score
does not depend on its neighbours: every sum runs along one text only.

Defined results: a null or empty text is one chunk of zero bytes; repeated rows
get equal scores; without usable labels of both classes the score is 0; an
empty table gives no rows; other columns are ignored. Memory in a worker: one
Arrow batch and STEP bytes' filter values at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .labelled import Adam, bias_for, epochs_for, fitted, fold, sigmoid, training_sample

WIDTH, FILTERS, HIDDEN = 6, 16, 12
CHUNK = 256
PER_CLASS = 800
TRAIN_CHUNKS = 24
EPOCHS, BATCH, RATE = 12, 32, 0.01
LEAST_STEPS = 200
THRESHOLD = 0.3
FOLDS, HELD = 5, 0
STEP = CHUNK * 256


def chunks_of(text: str) -> np.ndarray:
    """(chunks, CHUNK + WIDTH - 1) bytes; zero bytes fill up the last."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(data) // CHUNK))
    whole = np.zeros(n * CHUNK + WIDTH - 1, np.uint8)
    whole[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK + WIDTH - 1)[::CHUNK]


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.w = {
            "table": f(WIDTH * 256, FILTERS, scale=0.3), "bias": np.zeros(FILTERS, np.float32),
            "in": f(2 * FILTERS, HIDDEN, scale=0.3), "bin": np.zeros(HIDDEN, np.float32),
            "out": f(HIDDEN, scale=0.3), "b": np.zeros(1, np.float32),
        }

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest filter values (chunks, FILTERS) and their places."""
        held = self.w["table"][chunks[:, :CHUNK].astype(np.int64)]
        for j in range(1, WIDTH):
            held += self.w["table"][chunks[:, j : j + CHUNK].astype(np.int64) + 256 * j]
        at = held.argmax(axis=1)
        return np.take_along_axis(held, at[:, None], 1)[:, 0] + self.w["bias"], at

    def head(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Sums by axis, not matrix products, whose last bits can vary with the number of rows.
        hidden = np.tanh((feats[:, :, None] * self.w["in"]).sum(axis=1) + self.w["bin"])
        return hidden, (hidden * self.w["out"]).sum(axis=1) + self.w["b"]


def features(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean and maximum over each document's chunks of rectified values."""
    counts = np.diff(np.append(first, len(values)))[:, None]
    return np.concatenate([np.add.reduceat(values, first) / counts, np.maximum.reduceat(values, first)], axis=1)


def fit(sample: list[tuple[str, int]], epochs: int | None = None, seed: int = 5) -> tuple[Network, float] | None:
    """Network and bias; None without both classes."""
    if len({y for _, y in sample}) < 2:
        return None
    epochs = epochs or epochs_for(len(sample), EPOCHS, BATCH, LEAST_STEPS)
    rng, net = np.random.default_rng(seed), Network(seed)
    docs, y_all = [chunks_of(t) for t, _ in sample], np.array([y for _, y in sample])
    weight = np.where(y_all == 1, 0.5 / y_all.mean(), 0.5 / (1 - y_all.mean()))
    adam = Adam(net.w, RATE)
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / (epochs + 1))
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            picked = [docs[i] if len(docs[i]) <= TRAIN_CHUNKS else docs[i][rng.choice(len(docs[i]), TRAIN_CHUNKS, replace=False)] for i in some]
            counts = np.array([len(p) for p in picked])
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            chunks = np.concatenate(picked)
            raw, at = net.pooled(chunks)
            values = np.maximum(raw, 0)
            feats = features(values, first)
            hidden, logit = net.head(feats)
            d = ((sigmoid(logit) - y_all[some]) * weight[some] / len(some)).astype(np.float32)
            g = {"out": hidden.T @ d, "b": np.array([d.sum()], np.float32)}
            dh = d[:, None] * net.w["out"] * (1 - hidden * hidden)
            g["in"], g["bin"] = feats.T @ dh, dh.sum(axis=0)
            df = dh @ net.w["in"].T
            owner = np.repeat(np.arange(len(some)), counts)
            top = values == feats[owner, FILTERS:]
            share = top / np.maximum(1, np.add.reduceat(top.astype(np.float32), first))[owner]
            dv = ((df[:, :FILTERS] / counts[:, None])[owner] + df[owner, FILTERS:] * share) * (raw > 0)
            g["bias"] = dv.sum(axis=0)
            row = np.arange(len(chunks))[:, None]
            grad = np.zeros((FILTERS, WIDTH * 256), np.float32)
            for j in range(WIDTH):
                code = chunks[row, at + j].astype(np.int64) + 256 * j
                for f in range(FILTERS):
                    grad[f] += np.bincount(code[:, f], weights=dv[:, f], minlength=WIDTH * 256).astype(np.float32)
            g["table"] = grad.T.copy()
            adam.step(g)
    scorer = Scorer(net, 0.0)
    return net, bias_for(scorer.logits([t for t, _ in sample]), y_all, THRESHOLD)


class Scorer:
    def __init__(self, net: Network, bias: float):
        self.net, self.bias = net, bias
        t = net.w["table"].reshape(WIDTH, 256, FILTERS)
        # Value of a byte and the next: low byte first.
        self.pairs = [np.ascontiguousarray((t[j][None, :, :] + t[j + 1][:, None, :]).reshape(65536, FILTERS)) for j in range(0, WIDTH, 2)]

    def __getstate__(self):
        return {"net": self.net, "bias": self.bias}

    def __setstate__(self, state):
        self.__init__(state["net"], state["bias"])

    def maxima(self, data: np.ndarray) -> np.ndarray:
        """Greatest filter values of each chunk; data has a multiple of CHUNK and WIDTH - 1 bytes more."""
        n = (len(data) - WIDTH + 1) // CHUNK
        out = np.empty((n, FILTERS), np.float32)
        for k in range(0, n * CHUNK, STEP):
            size = min(STEP, n * CHUNK - k)
            part = data[k : k + size + WIDTH - 1].astype(np.uint16)
            code = part[:-1] | part[1:] << np.uint16(8)
            held = self.pairs[0].take(code[:size], axis=0)
            for j in range(1, WIDTH // 2):
                held += self.pairs[j].take(code[2 * j : 2 * j + size], axis=0)
            held.reshape(-1, CHUNK, FILTERS).max(axis=1, out=out[k // CHUNK : (k + size) // CHUNK])
        return out + self.net.w["bias"]

    def logits(self, texts: list[str]) -> np.ndarray:
        """The texts' chunks lie one after another, so that short texts share the work of a step."""
        out, some, held = [], [], 0

        def flush() -> None:
            raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in some]
            counts = np.array([max(1, -(-len(r) // CHUNK)) for r in raw])
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            # A chunk's last WIDTH - 1 windows reach into the next chunk; between texts a zero chunk keeps them apart.
            begin = (first + np.arange(len(raw))) * CHUNK
            data = np.zeros((counts.sum() + len(raw)) * CHUNK + WIDTH - 1, np.uint8)
            for b, r in zip(begin, raw):
                data[b : b + len(r)] = r
            keep = np.ones(counts.sum() + len(raw), bool)
            keep[np.cumsum(counts + 1) - 1] = False
            values = np.maximum(self.maxima(data)[keep], 0)
            out.append(self.net.head(features(values, first))[1])
            some.clear()

        for t in texts:
            some.append(t)
            held += len(t) + CHUNK
            if held > 1 << 20:
                flush()
                held = 0
        if some:
            flush()
        return np.concatenate(out) + self.bias if out else np.zeros(0)


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
            yield pd.Series(sigmoid(scorer.logits(texts.tolist())), dtype="float64")

    return docs.withColumn(name, run(text_of()))


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = training_sample(docs, table(spark, sf_dir, "labels"), "quality", FOLDS, HELD, PER_CLASS)
    out = scored(docs, sample)
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
