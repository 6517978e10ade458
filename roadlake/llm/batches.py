"""Arrow batches of a task, by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key in turn, from batches sorted by their first `keys` columns."""
    last, held = None, []
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
        start = 0
        for at in range(len(rows) + 1):
            if at == len(rows) or rows[at] != rows[start]:
                if at > start:
                    if rows[start] != last and held:
                        yield last, pa.Table.from_batches(held)
                        held = []
                    last = rows[start]
                    held.append(batch.slice(start, at - start))
                start = at
    if held:
        yield last, pa.Table.from_batches(held)


def unite(label: np.ndarray, at: np.ndarray) -> None:
    """Gives the groups of the places `at` one label, the least of theirs."""
    met = label[at]
    if (met != met[0]).any():
        met = np.unique(met)
        label[np.isin(label, met)] = met[0]
