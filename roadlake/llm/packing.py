"""Packing: harmonic classes of reciprocal capacity with a fixed piece count per bin.

A piece of class k is at most capacity / k long and a bin of class k takes
exactly k pieces, so a bin's number and a piece's place in it follow from the
piece's rank among those of its length: no task needs to see what others packed.
A document that exceeds a bin is cut. So is a rest whose length is not within
one SLACK-th of the greatest of its class, floor(capacity / k): a piece of a
class's greatest length goes first, and what stays has LEAST ids or more. Only
a whole document can be a shorter piece, so no piece is the closing id alone
unless its text is empty. Pieces that do not fill a bin of their length (fewer
than k, at most about 16,000 in all, whatever the input) are packed first-fit
decreasing.

Defined results: a null or empty text is the closing id alone; repeated rows
are packed each; an empty table gives no rows; other columns are ignored.
Memory in a worker: one Arrow batch and word tables of CACHE and LETTERS entries and what one text adds.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table, text_of
from .ranks import ranked

CAPACITY = 2048
CLOSING_ID = 1
#: Least length of a piece of a cut document; a piece may fall short of its class by a SLACK-th.
LEAST, SLACK = 32, 128
#: Words whose ids a worker keeps, and lower-case letter strings (some 200 bytes each).
CACHE, LETTERS, GROUP = 400_000, 700_000, 1 << 20
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts, by a table of the ids of words.

    The vocabulary's pattern drops white space and never spans it, so the ids of a text are those of its words in
    turn. It also parts letters from punctuation and ignores case: words that are letters and closing punctuation
    share the ids of their lower-case letters, each a unit that the encoding numbers.
    """

    CLOSING = ".,;:!?#$%&*()\"|-+=/_~^@[]{}"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.closing: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _add(self, words: set[bytes]) -> None:
        parted = []
        for w in words:
            text = w.decode()
            core = text.rstrip(self.CLOSING)
            low = core.lower()
            if low.isalpha() and "\u03a3" not in core and "<|" not in text:
                parted.append((w, low, text[len(core) :]))
            else:
                self.table[w] = self._ids(text)
        new = list({low for _, low, _ in parted if low not in self.letters})
        for k in range(0, len(new), 500):
            found = self.tokenizer.encode(" ".join(new[k : k + 500]), add_special_tokens=False)
            data, unit = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids)
            ends = [*(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
            assert len(ends) == len(new[k : k + 500])
            begin = 0
            for low, end in zip(new[k : k + 500], ends):
                self.letters[low] = data[4 * begin : 4 * end]
                begin = end
        for w, low, tail in parted:
            if tail not in self.closing:
                self.closing[tail] = self._ids(tail)
            self.table[w] = self.letters[low] + self.closing[tail]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; the new words of some GROUP characters of text are looked up together."""
        group, held = [], 0
        for text in texts:
            group.append(text.encode("utf-8", "replace").split())
            held += len(text)
            if held >= GROUP:
                yield from self._ids_of(group)
                group, held = [], 0
        yield from self._ids_of(group)

    def _ids_of(self, group: list[list[bytes]]) -> Iterator[bytes]:
        for table, most in ((self.table, CACHE), (self.letters, LETTERS), (self.closing, CACHE)):
            if len(table) > most:
                table.clear()
        self.closing[""] = b""
        self._add(set().union(*group).difference(self.table))
        for words in group:
            yield b"".join(map(self.table.__getitem__, words))


_tokenizers: dict[str, WordTokenizer] = {}


def class_cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document: whole bins, then pieces of classes' greatest lengths, then one that may fall short a little."""
    whole, rest = divmod(length, capacity)
    if whole and 0 < rest < LEAST:
        whole, rest = whole - 1, rest + capacity
    out = [capacity] * whole
    while rest:
        if rest <= capacity:
            short = capacity // (capacity // rest) - rest
            if short * SLACK <= rest or rest < 2 * LEAST:
                out.append(rest)
                break
        most = min(rest - LEAST, capacity - 1)
        k = capacity // most
        out.append(capacity // k if capacity // k <= most else capacity // (k + 1))
        rest -= out[-1]
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    path, closing = path or vocabulary_path(), np.array([CLOSING_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        tokenizer = _tokenizers[path]
        for batch in batches:
            rows: list[list[int | None]] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.encode_all(t.as_py() for t in batch.column(1))):
                ids += closing
                n, at = len(ids) // 4, 0
                for size in class_cuts(n, capacity):
                    for column, value in zip(rows, (doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n)):
                        column.append(value)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return own.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and place of each length, in the given order."""
    room = np.zeros(0, np.int64)
    bins, places = [], []
    for n in lengths:
        fit = np.flatnonzero(room >= n)
        b = int(fit[0]) if len(fit) else len(room)
        if b == len(room):
            room = np.append(room, capacity)
        bins.append(b)
        places.append(capacity - int(room[b]))
        room[b] -= n
    return bins, places


def pack(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; those of one length share bins."""
    cuts = cut(cuts)
    each = F.expr(f"{capacity} div length")
    own = cut(ranked(cuts, "length", ["doc_id", "start", "ids_crc32", "doc_tokens"]).withColumn("_bins", F.col("_size") - F.col("_size") % each))
    classes = own.groupBy("length").agg(F.expr(f"max(_size) div max({capacity} div length)").alias("_full"))  # at most `capacity` rows
    classes = classes.withColumn("_base", F.sum("_full").over(W.orderBy("length")) - F.col("_full")).withColumn("_all", F.sum("_full").over(W.partitionBy()))
    own = own.join(F.broadcast(classes), "length")
    full = own.filter("_rank < _bins").select(*cuts.columns, (F.col("_base") + F.expr(f"_rank div ({capacity} div length)")).alias("sequence_id"), (F.expr(f"_rank % ({capacity} div length)") * F.col("length")).alias("offset"))

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, places = first_fit(pdf["length"].tolist(), capacity)
        return pdf.assign(sequence_id=pdf["_all"] + pd.Series(bins, dtype="int64"), offset=pd.Series(places, dtype="int64")).drop(columns="_all")

    left = own.filter("_rank >= _bins").select(*cuts.columns, "_all")  # fewer pieces a class than a bin takes
    left = left.groupBy(F.lit(0).alias("_one")).applyInPandas(rest, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(left)


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
