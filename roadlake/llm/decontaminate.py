"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

A document is contaminated by an item if some item-sized window of its words is
within `1 - similarity` of the item in word edits. The CGK random walk reads a
window of n words with 3n steps, each of which puts out the current word and
moves on by a random bit of (step, word): windows a few edits apart then agree
in many of the 3n places. Each of R walks samples SAMPLED places to a key, and
windows that share a key with an item are verified by the exact edit distance.

How far windows agree falls with their length and their edits, so R is measured
for each class of lengths: pairs with all the edits that the length permits, by
changes, by insertions and deletions and by both, are drawn and walked, and R is
the least number of walks that reaches `recall` on the worst of the three.

Before that, two bounds that lose nothing: an edit breaks two word pairs at
most, so a window with c of an item's d different word pairs is at least
(d - c) / 2 edits away. Windows beyond the permitted edits are not embedded, nor
are those that cannot be nearer than one that is verified.

The benchmark goes to the workers in blocks of about BLOCK / 2 different items
and BLOCK_CHARS / 2 characters; each block is one pass over the documents. Every
window of every whole text is considered.

Words: lower-cased, ASCII punctuation parts them. Defined results: null or empty texts
have no words and are clean, and match nothing as items; an item so short that no
edit is permitted is looked up as it is; the filter leaves out items of fewer
than LEAST_WORDS words, which are no evidence; items of one text are looked up once and reported each; repeated
rows are reported each; of equally near windows the first counts; an empty table
on either side gives no rows; other columns are ignored. Memory in a worker: the
block, one Arrow batch, and some CELLS numbers at a time (more for one item of
more words).
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, table, text_of, without

SIMILARITY = 0.8
RECALL = 0.999
SAMPLED = 3
BLOCK, BLOCK_CHARS = 20_000, 50_000_000
#: What the filtering stage takes for contamination: a shared phrase of fewer words is none.
LEAST_WORDS = 5
CELLS = 1 << 20
#: Pairs of each kind and walks by which agreement is measured.
PAIRS, TRIALS = 32, 32
OUT = "rep long, start long, words long, edits long"
_CLEAN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_in(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_CLEAN).split()


def edit_distance(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Row-wise edit distance of padded word arrays: a full row of the table at each step."""
    places = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(places, (len(a), len(places))).astype(np.int32)
    out = np.where(la == 0, lb, 0).astype(np.int32)
    each = np.arange(len(a))
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i : i + 1]))
        row = np.minimum.accumulate(new - places, axis=1) + places
        done = la == i + 1
        out[done] = row[each[done], lb[done]]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def walk(windows: np.ndarray, steps: int, walks: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The word (walk, window) that each step puts out. Windows are padded with -1, one more at least, where walks end up."""
    at, each, last = np.zeros((walks, len(windows)), np.int64), np.arange(len(windows)), windows.shape[1] - 1
    number = (np.arange(walks, dtype=np.uint64) << np.uint64(32))[:, None] + np.uint64(seed)
    for j in range(steps):
        symbol = windows[each, at]
        yield symbol
        bit = _mix(symbol.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mix(number + np.uint64(j)))
        at = np.minimum(at + (bit >> np.uint64(63)).astype(np.int64), last)


def edited(words: np.ndarray, edits: int, kind: str, rng: np.random.Generator, fresh: int) -> np.ndarray:
    """A copy with so many random edits, new words counted from `fresh`: changes, insertions with deletions, or both."""
    own = words.tolist()
    for e in range(edits):
        at = int(rng.integers(0, len(own)))
        step = kind if kind != "both" else ("change", "move")[int(rng.integers(0, 2))]
        if step == "change":
            own[at] = fresh + e
        elif (e % 2 == 0) == (kind == "move"):
            own.insert(at, fresh + e)
        else:
            del own[at]
    return np.array(own[: len(words)] + [-1] * (len(words) - len(own)), np.int64)


def walks_for(size: int, edits: int, recall: float, seed: int = 42) -> int:
    """Walks by which windows of `size` different words and `edits` edits share a key with probability `recall`, as measured."""
    rng, most = np.random.default_rng(seed), 1
    item = np.arange(1, size + 1)
    for kind in ("change", "move", "both"):
        copies = np.stack([item, *[edited(item, edits, kind, rng, size + 1) for _ in range(PAIRS)]])
        copies = np.concatenate([copies, np.full((len(copies), 1), -1, np.int64)], axis=1)
        agree = np.zeros((TRIALS, PAIRS))
        for symbol in walk(copies, 3 * size, TRIALS, seed + 1000):
            agree += symbol[:, 1:] == symbol[:, :1]
        shared = np.maximum(((agree / (3 * size)) ** SAMPLED).mean(axis=0), 1e-4)
        walks = 1
        while ((1 - shared) ** walks).mean() > 1 - recall:
            walks += 1
        most = max(most, walks)
    return most


def length_class(size: np.ndarray) -> np.ndarray:
    """Lengths of a class are within a factor of 1.3."""
    return np.floor(np.log(size) / np.log(1.3)).astype(np.int64)


class ItemIndex:
    """Words, word pairs and keys of a block of different benchmark items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float = RECALL):
        split = [(i, w) for i, t in items if (w := words_in(t))]
        self.vocabulary: dict[bytes, int] = {}
        self.rows = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in split]
        self.ids = np.array([i for i, _ in split], np.int64)
        self.size = np.array([len(r) for r in self.rows], np.int64)
        self.edits = np.floor((1 - similarity) * self.size + 1e-9).astype(np.int64)
        self.base = len(self.vocabulary) + 1
        self.single = {int(r[0]): k for k, r in enumerate(self.rows) if len(r) == 1}
        if not self.rows:
            return
        each = [np.unique(r[:-1] * self.base + r[1:]) for r in self.rows]
        pairs = np.concatenate(each)
        owner = np.concatenate([np.full(len(e), k) for k, e in enumerate(each)])
        self.pairs_of = np.array([len(e) for e in each])
        self.need = np.maximum(1, self.pairs_of - 2 * self.edits)
        order = np.argsort(pairs, kind="stable")
        self.pairs, first = np.unique(pairs[order], return_index=True)
        self.first = np.append(first, len(order))
        self.owner = owner[order]
        self.slots = [np.searchsorted(self.pairs, e) for e in each]
        self.cls = length_class(self.size)
        self.walks = {c: walks_for(int(self.size[self.cls == c].max()), int(self.edits[self.cls == c].max()), recall) for c in np.unique(self.cls).tolist()}
        found = [self._keys([(self.rows[k], k) for k in part]) for part in self._parts(np.arange(len(self.rows)))]
        keys = np.concatenate([k.reshape(-1) for _, k in found])
        item = np.concatenate([np.broadcast_to(i, k.shape).reshape(-1) for i, k in found])
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_item = keys[order], item[order]

    def _parts(self, items: np.ndarray) -> Iterator[np.ndarray]:
        """Places in `items`, dealt by length class, in parts whose tables stay within CELLS."""
        for c in np.unique(self.cls[items]).tolist():
            own = np.flatnonzero(self.cls[items] == c)
            longest = int(self.size[items[own]].max())
            step = max(1, CELLS // (self.walks[c] * SAMPLED + longest))
            for k in range(0, len(own), step):
                yield own[k : k + step]

    def _padded(self, parts: list[np.ndarray], longest: int) -> np.ndarray:
        out = np.full((len(parts), longest + 1), -1, np.int64)
        for k, p in enumerate(parts):
            out[k, : len(p)] = p
        return out

    def _keys(self, windows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(items, keys (walk, window)) of windows (codes, item) of one length class."""
        item = np.array([k for _, k in windows])
        size, walks = self.size[item], self.walks[int(self.cls[item[0]])]
        share = _mix(np.arange(walks * SAMPLED, dtype=np.uint64) + np.uint64(7)).reshape(walks, 1, SAMPLED).astype(np.float64) / 2.0**64
        places = np.minimum((share * (3 * size)[None, :, None]).astype(np.int64), 3 * size[None, :, None] - 1)
        seen, longest = np.empty(places.shape, np.int64), int(size.max())
        for j, symbol in enumerate(walk(self._padded([w for w, _ in windows], longest), 3 * longest, walks)):
            np.copyto(seen, symbol[:, :, None], where=places == j)
        seen = seen.astype(np.uint64)
        key = _mix((np.arange(walks, dtype=np.uint64) << np.uint64(40))[:, None] + size.astype(np.uint64)[None, :])
        for k in range(SAMPLED):
            key = _mix(key ^ (seen[:, :, k] + np.uint64(0x9E3779B97F4A7C15)))
        return item, key

    def windows(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, least edits) of the windows that hold enough of the item's different word pairs, or are an item of one word."""
        return self.words_alone(codes) + self.with_pairs(codes)

    def words_alone(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        if not self.single:
            return []
        code, first = np.unique(codes, return_index=True)
        return [(self.single[c], int(f), 0) for c, f in zip(code.tolist(), first) if c in self.single]

    def with_pairs(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        both = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
        if not len(both):
            return []
        pair = codes[both] * self.base + codes[both + 1]
        slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        hit = self.pairs[slot] == pair
        slot, both = slot[hit], both[hit]
        if len(both) < self.need.min():
            return []
        # Items that have enough different pairs somewhere in the text; most texts end here.
        seen = np.unique(slot)
        times = self.first[seen + 1] - self.first[seen]
        begin = np.repeat(self.first[seen] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
        counts = np.bincount(self.owner[begin + np.arange(times.sum())], minlength=len(self.ids))
        out = []
        for k in np.flatnonzero(counts >= self.need):
            own = np.isin(slot, self.slots[k])
            place, pair = both[own], slot[own]
            order = np.argsort(pair, kind="stable")
            before = np.full(len(place), -1)  # where the same pair was last
            again = pair[order][1:] == pair[order][:-1]
            before[order[1:][again]] = place[order[:-1][again]]
            # A pair at p is the first of its kind in the windows that start after `before` and hold p and p + 1.
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, np.maximum(np.maximum(before + 1, place - self.size[k] + 2), 0), 1)
            np.add.at(change, place + 1, -1)
            held = np.cumsum(change[:-1])
            at = np.flatnonzero(held >= self.need[k])
            least = (self.pairs_of[k] - held[at] + 1) // 2
            out += [(int(k), s, e) for s, e in zip(at.tolist(), least.tolist())]
        return out

    def near(self, found: list[tuple[int, np.ndarray, int, int, int]]) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        """(document, item, (edits, start, words)) of the windows (document, codes, item, start, _) that share a key with an item within its edits."""
        for part in self._parts(np.array([f[2] for f in found], np.int64)):
            some = [found[k] for k in part]
            cuts = [codes[s : s + self.size[i]] for _, codes, i, s, _ in some]
            _, keys = self._keys([(w, f[2]) for w, f in zip(cuts, some)])
            flat = keys.reshape(-1)
            low, high = np.searchsorted(self.keys, flat, "left"), np.searchsorted(self.keys, flat, "right")
            met = np.flatnonzero(high > low)
            pairs = {(int(k) % len(some), int(i)) for k in met for i in self.key_item[low[k] : high[k]]}
            pairs = sorted(pairs, key=lambda p: (self.size[p[1]], p))
            longest = int(self.size[[f[2] for f in some]].max())
            step = max(1, CELLS // (8 * longest))
            for k in range(0, len(pairs), step):
                row, item = np.array(pairs[k : k + step]).T
                length = np.array([len(cuts[r]) for r in row])
                windows, items = self._padded([cuts[r] for r in row], longest)[:, :-1], self._padded([self.rows[i] for i in item], longest)[:, :-1]
                edits = edit_distance(windows, length, items, self.size[item])
                for j in np.flatnonzero(edits <= self.edits[item]):
                    yield some[row[j]][0], int(item[j]), (int(edits[j]), some[row[j]][3], int(length[j]))

    def match(self, found: list[tuple[int, np.ndarray, int, int, int]]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Best (edits, start, words) for (document, item) among windows (document, codes, item, start, least edits)."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        first: dict[tuple[int, int], int] = {}
        for k, (d, _, i, s, least) in enumerate(found):
            old = first.get((d, i))
            if old is None or (least, s) < (found[old][4], found[old][3]):
                first[d, i] = k
        chosen = set(first.values())
        for d, i, value in self.near([found[k] for k in sorted(chosen)]) if found else ():
            best[d, i] = min(value, best.get((d, i), value))
        rest = [f for k, f in enumerate(found) if k not in chosen and ((f[0], f[2]) not in best or (f[4], f[3]) < best[f[0], f[2]][:2])]
        for d, i, value in self.near(rest) if rest else ():
            best[d, i] = min(value, best.get((d, i), value))
        return best


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, key: str = "doc_id") -> DataFrame:
    """`key`, item_id, start and words of the nearest window (counted in words), edits.

    One block at a time is made, sent out and, once its rows are written, freed.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("_key"), text_of().alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).withColumn("rep", F.xxhash64("text"))
    texts = items.select("rep", "text").distinct()
    n, chars = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    blocks = max(1, math.ceil(n / (block / 2)), math.ceil((chars or 0) / (BLOCK_CHARS / 2)))
    out = None
    for b in range(blocks):
        some = texts.filter(F.pmod("rep", F.lit(blocks)) == b).collect()  # about half of the bounds
        shared = spark.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in some], similarity, recall))
        found = cut(own.mapInArrow(_finder(shared), f"_key {kind}, {OUT}"))
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out.join(items.select("rep", "item_id"), "rep").select(F.col("_key").alias(key), "item_id", "start", "words", "edits")


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        code = index.vocabulary.get
        for batch in batches:
            own, found = batch.column(0), []
            if len(index.ids):
                for d, text in enumerate(batch.column(1)):
                    words = words_in(text.as_py())
                    codes = np.fromiter(map(code, words, repeat(0)), np.int64, len(words))
                    found += [(d, codes, i, s, e) for i, s, e in index.windows(codes)]
            best = sorted(index.match(found).items())
            yield pa.RecordBatch.from_arrays(
                [own.take(pa.array([d for (d, _), _ in best], pa.int64())), *(pa.array(c, pa.int64()) for c in (
                    [int(index.ids[i]) for (_, i), _ in best], [v[1] for _, v in best], [v[2] for _, v in best], [v[0] for _, v in best]))],
                names=["_key", "rep", "start", "words", "edits"])

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents that no item of `least_words` words or more contaminates, with their columns.

    Rows are decided by a digest of doc_id and text, so of several texts of one doc_id, or without one, only those go
    that hold an item.
    """
    mark = free_name(docs, "_mark")
    marked = docs.withColumn(mark, F.md5(F.concat_ws("\x00", F.col("doc_id").cast("string"), text_of())))
    gone = leaks(marked, benchmark, key=mark).filter(F.col("words") >= least_words)
    return without(marked, cut(gone.select(mark).distinct()), mark).drop(mark)


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
