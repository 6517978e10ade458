"""Bounded samples of labelled documents and measures of a classifier."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(folds)).cast("int")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> DataFrame:
    """doc_id, text, y: at most per_class documents of each label, the first by a hash of doc_id, none of the held-out fold.

    Of several texts of one doc_id the least counts, so the bound is one of rows.
    """
    usable = labels.filter((fold("doc_id", folds) != held) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = usable.select("doc_id", F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("h")).distinct()
    picked = [chosen.filter(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]).select("doc_id", "y"))  # at most 2 * per_class rows
    return docs.select("doc_id", text_of().alias("text")).join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fitted(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], object]) -> object:
    """fit() of the sample's (text, label) pairs, run by one task; only the model reaches the driver.

    The sample is bounded, so one task can hold it; a lost executor repeats the same fit. None for an empty sample.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in batches for r in zip(pdf["doc_id"], pdf["text"], pdf["y"])]
        rows = sorted(rows)
        yield pd.DataFrame({"model": [pickle.dumps(fit([(t, int(y)) for _, t, y in rows]))]})

    rows = sample.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "y").repartition(1)
    model = rows.mapInPandas(run, "model binary").first()
    return None if model is None else pickle.loads(model[0])


def epochs_for(rows: int, epochs: int, batch: int, least_steps: int) -> int:
    """The usual epochs, or more where the sample is so small that they make under least_steps steps."""
    return max(epochs, -(-least_steps // max(1, -(-rows // batch))))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scatter_add(n: int, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """n rows, each the sum of the values with its index."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        sorted_index = index[order]
        first = np.flatnonzero(np.diff(sorted_index, prepend=-1))
        out[sorted_index[first]] = np.add.reduceat(values[order], first)
    return out


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)


def bias_for(logits: np.ndarray, y: np.ndarray, threshold: float) -> float:
    """The shift of the logits that puts the best balanced cut of the training rows, three quarters up where it has room, at `threshold`."""
    order = np.argsort(logits)
    z, t = logits[order], y[order]
    below1, below0 = np.cumsum(t) / max(1, t.sum()), np.cumsum(1 - t) / max(1, (1 - t).sum())
    gain = below0 - below1
    best = gain >= gain.max() - 1e-9
    k = int(np.quantile(np.flatnonzero(best), 0.75))
    cut = (z[k] + z[min(k + 1, len(z) - 1)]) / 2
    return float(np.log(threshold / (1 - threshold)) - cut)
