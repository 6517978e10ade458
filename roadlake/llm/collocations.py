"""Collocations: phrases of two and three words that stand together more often than their parts would.

Counting is by address. The words that may be in a frequent phrase are ranked by frequency within a language, and a pair of
ranks is a cell of a matrix that is split into tiles of TILE x TILE cells. A task counts a tile in which a chunk of the
corpus has at least DENSE pairs by one dense bincount over its cells; the pairs of all other tiles are sorted as
coordinates and their runs counted. Spark adds the counts up. Frequent pairs are ranked again, and a pair's rank with the
rank of the word that follows is the cell of a three-word phrase, counted in the same way; a phrase whose pairs are not
both frequent is not counted, as it cannot be frequent itself.

Addresses are for the HEAD_WORDS words and HEAD_PAIRS pairs of greatest count, so what tasks are sent does not grow with
the corpus. Phrases with a frequent word or pair beyond those are counted by their text; a map of hashes, 16 bits for each
of these (128 MB at most), keeps infrequent ones out (it lets some through, whose counts are then too low to stay). Counts are
of whole texts and exact at every size.

Defined results: a null text is empty, a null language is `und`; other languages are taken as they stand; repeated rows
count as often as they occur; doc_id is not read, other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PAGE, bits_for, cut, table, text_of

LEAST, SHARE, TOP = 10, 50, 2000
HEAD_WORDS, HEAD_PAIRS = 1 << 18, 1 << 20
TILE, DENSE = 1 << 10, 1 << 15
#: Words that a task takes at once, and distinct ones that it counts before it hands them on.
CHUNK, FLUSH = 1 << 19, 1 << 16
#: Rows of an Arrow batch that a task hands on.
ROWS = 1 << 15
_BREAK = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)
#: Codes of what has no address: not in a frequent phrase, or counted by text.
_NONE, _TAIL = -1, -2


def tokens(text: str) -> list[bytes]:
    """The words of a whole text, with _BREAK between pieces."""
    return text.encode("utf-8").translate(_FOLD).replace(_BREAK, b" \xff ").split()


def tile_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a, b) of addresses and how often each occurs: dense tiles by bincount, sparse ones by sorted coordinates."""
    if not len(a):
        return a, b, a
    across = int(b.max()) // TILE + 1
    tile = (a // TILE) * across + b // TILE
    found = []
    rest = np.ones(len(a), bool)
    for t in np.flatnonzero(np.bincount(tile) >= DENSE):
        at = tile == t
        rest &= ~at
        cells = np.bincount((a[at] % TILE) * TILE + b[at] % TILE, minlength=TILE * TILE)
        full = np.flatnonzero(cells)
        found.append(((t // across) * TILE + full // TILE, (t % across) * TILE + full % TILE, cells[full]))
    code, n = np.unique((a[rest] << 32) | b[rest], return_counts=True)
    found.append((code >> 32, code & 0xFFFFFFFF, n))
    return tuple(np.concatenate(x) for x in zip(*found))


class Addresses:
    """Ranks of words and pairs by language, and maps of the frequent ones that have none."""

    def __init__(self, words: dict[str, dict[bytes, int]], tail_words: np.ndarray | None, pairs: dict[str, tuple[np.ndarray, np.ndarray]] | None = None, tail_pairs: np.ndarray | None = None):
        self.words, self.tail_words, self.pairs, self.tail_pairs = words, tail_words, pairs, tail_pairs

    def codes(self, lang: str, words: list[bytes]) -> np.ndarray:
        own = self.words.get(lang, {})
        code = np.fromiter(map(own.get, words, repeat(_NONE)), np.int64, len(words))
        if self.tail_words is not None:
            known: dict[bytes, bool] = {_BREAK: False}
            for i in np.flatnonzero(code == _NONE).tolist():
                w = words[i]
                if w not in known:
                    known[w] = _may_hold(self.tail_words, w)
                if known[w]:
                    code[i] = _TAIL
        return code

    def pair_codes(self, lang: str, words: list[bytes], code: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each place but the last."""
        out = np.full(max(0, len(code) - 1), _NONE, np.int64)
        known, ranks = self.pairs.get(lang, (np.empty(0, np.int64), np.empty(0, np.int64)))
        both = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
        if len(known):
            key = (code[both] << 32) | code[both + 1]
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            out[both] = np.where(known[at] == key, ranks[at], _NONE)
        if self.tail_pairs is not None:
            seen: dict[bytes, bool] = {}
            for i in np.flatnonzero((out == _NONE) & (code[:-1] != _NONE) & (code[1:] != _NONE)).tolist():
                pair = words[i] + b" " + words[i + 1]
                if pair not in seen:
                    seen[pair] = _may_hold(self.tail_pairs, pair)
                if seen[pair]:
                    out[i] = _TAIL
        return out


def _may_hold(bits: np.ndarray, phrase: bytes) -> bool:
    import xxhash

    at = xxhash.xxh64_intdigest(phrase, 42) & (8 * len(bits) - 1)
    return bool(bits[at >> 3] >> (at & 7) & 1)


def map_of(phrases: DataFrame) -> np.ndarray | None:
    """A map of the hashes of phrases(phrase), 16 bits and more for each of them; None for no phrases."""
    n = phrases.count()
    if not n:
        return None
    bits = bits_for(n)
    at = F.pmod(F.xxhash64("phrase"), F.lit(bits)) + 1
    pages = phrases.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pages.toLocalIterator():
        out[(r["k"] - 1) * (PAGE // 8) : r["k"] * (PAGE // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, phrase, n: every word of texts(lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            """Everything held, in small batches."""
            while held:
                lang, counts = held.popitem()
                counts.pop(_BREAK, None)
                words = list(counts)
                for k in range(0, len(words), ROWS):
                    some = words[k : k + ROWS]
                    columns = [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array(map(counts.get, some), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, Counter()).update(tokens(text.as_py()))
                if sum(map(len, held.values())) > FLUSH:
                    yield from out()
        yield from out()

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(texts: DataFrame, addresses: Addresses) -> DataFrame:
    """lang, a, b, phrase, n: phrases of two words, or of three if pairs have addresses, by address (phrase null) or text (a, b null)."""
    shared = texts.sparkSession.sparkContext.broadcast(addresses)

    def counted(lang: str, parts: list[np.ndarray], words: list[bytes]) -> Iterator[pa.RecordBatch]:
        """The counts of a chunk, in small batches; words: those of the codes, empty where everything frequent has an address."""
        known, size = shared.value, 2
        code = last = np.concatenate(parts).astype(np.int64)
        first = code[:-1]
        if known.pairs is not None:
            size, pair = 3, known.pair_codes(lang, words, code)
            first, last = np.where(pair[1:] == _NONE, _NONE, pair[:-1]), code[1:]
        last = last[1:]
        at = (first >= 0) & (last >= 0)
        a, b, n = tile_counts(first[at], last[at])
        for k in range(0, len(a), ROWS):
            rows = len(a[k : k + ROWS])
            yield batch_of([lang] * rows, a[k : k + ROWS], b[k : k + ROWS], pa.nulls(rows, pa.string()), n[k : k + ROWS])
        texts = Counter(b" ".join(words[i : i + size]) for i in np.flatnonzero((first != _NONE) & (last != _NONE) & ~at).tolist()) if words else {}
        if texts:
            blank = pa.nulls(len(texts), pa.int64())
            yield batch_of([lang] * len(texts), blank, blank, [t.decode("utf-8") for t in texts], list(texts.values()))

    def batch_of(lang, a, b, phrase, n) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        columns = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip((lang, a, b, phrase, n), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are held as codes, four bytes a word; their words are kept only where some phrases are counted by text."""
        known = shared.value
        by_text = known.tail_words is not None or known.tail_pairs is not None
        held: dict[str, tuple[list[np.ndarray], list[bytes]]] = {}
        size: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = tokens(text.as_py())
                words.append(_BREAK)
                parts, kept = held.setdefault(lang, ([], []))
                parts.append(known.codes(lang, words).astype(np.int32))
                size[lang] += len(words)
                if by_text:
                    kept += words
                if size[lang] > CHUNK:
                    yield from counted(lang, *held.pop(lang))
                    size[lang] = 0
            if size.total() > 2 * CHUNK:
                for lang in list(held):
                    yield from counted(lang, *held.pop(lang))
                size.clear()
        for lang, (parts, kept) in held.items():
            yield from counted(lang, parts, kept)

    rows = texts.mapInArrow(run, "lang string, a long, b long, phrase string, n long")
    return rows.groupBy("lang", "a", "b", "phrase").agg(F.sum("n").alias("n"))


def ranked_head(frequent: DataFrame, most: int, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The at most `most` rows of greatest n of frequent(lang, phrase, n, *columns), with `id`, their rank within the language; and the rest.

    Rows of one n stay together. The table of counts has one row for each n that occurs.
    """
    counts = frequent.groupBy("n").agg(F.count("*").alias("rows"))
    within = counts.withColumn("rows", F.sum("rows").over(Window.orderBy(F.desc("n")))).filter(F.col("rows") <= most)
    least = within.agg(F.min("n")).first()[0]
    if least is None:
        return frequent.limit(0).withColumn("id", F.lit(0)), frequent
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "phrase")
    head = cut(frequent.filter(F.col("n") >= least).select("lang", "phrase", "n", *columns).withColumn("id", F.row_number().over(order) - 1))
    return head, frequent.filter(F.col("n") < least)


def frequent_phrases(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables of words, pairs and triples that occur LEAST times or more (lang, phrase, n), and lang, n of all word occurrences."""
    counts = cut(word_counts(texts))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counts.filter(F.col("n") >= LEAST)
    head, tail = ranked_head(words, HEAD_WORDS)
    ranks: dict[str, dict[bytes, int]] = {}
    for r in head.toLocalIterator():
        ranks.setdefault(r["lang"], {})[r["phrase"].encode()] = r["id"]
    addresses = Addresses(ranks, map_of(tail))
    named = head.select("lang", F.col("id").alias("b"), F.col("phrase").alias("last"))

    def text_of_address(found: DataFrame, firsts: DataFrame) -> DataFrame:
        by_address = found.filter("phrase is null").drop("phrase").join(firsts, ["lang", "a"]).join(named, ["lang", "b"])
        return by_address.select("lang", F.concat_ws(" ", "first", "last").alias("phrase"), "n", "a", "b").unionByName(found.filter("phrase is not null"))

    found = cut(phrase_counts(texts, addresses).filter(F.col("n") >= LEAST))
    pairs = cut(text_of_address(found, head.select("lang", F.col("id").alias("a"), F.col("phrase").alias("first"))))
    pair_head, _ = ranked_head(pairs.filter("a is not null"), HEAD_PAIRS, "a", "b")
    pair_tail = pairs.join(pair_head.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    held: dict[str, list[tuple[int, int]]] = {}
    for r in pair_head.toLocalIterator():
        held.setdefault(r["lang"], []).append((r["a"] << 32 | r["b"], r["id"]))
    addresses.pairs = {lang: tuple(np.array(sorted(rows), np.int64).T) for lang, rows in held.items()}
    addresses.tail_pairs = map_of(pair_tail)
    found = cut(phrase_counts(texts, addresses).filter(F.col("n") >= LEAST))
    triples = cut(text_of_address(found, pair_head.select("lang", F.col("id").alias("a"), F.col("phrase").alias("first"))))
    return words, pairs.select("lang", "phrase", "n"), triples.select("lang", "phrase", "n"), totals


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    words, pairs, triples, totals = frequent_phrases(texts)
    count = lambda rows, part, n: rows.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    at = lambda i: F.split("phrase", " ")[i]
    two = pairs.select("lang", "phrase", F.col("n").alias("a"), at(0).alias("w1"), at(1).alias("w2"))
    three = triples.select("lang", "phrase", F.col("n").alias("a"), at(0).alias("w1"), at(2).alias("w3"))
    three = three.withColumn("p1", F.concat_ws(" ", "w1", at(1))).withColumn("p2", F.concat_ws(" ", at(1), "w3"))
    within = three.select("lang", F.explode(F.array("p1", "p2")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    two = two.join(within, ["lang", "phrase"], "left").filter(100 * F.coalesce("longer", F.lit(0)) < SHARE * F.col("a")).drop("longer")
    two = two.join(count(words, "w1", "l"), ["lang", "w1"]).join(count(words, "w2", "r"), ["lang", "w2"])
    three = three.join(count(words, "w1", "l1"), ["lang", "w1"]).join(count(pairs, "p2", "r1"), ["lang", "p2"])
    three = three.join(count(pairs, "p1", "l2"), ["lang", "p1"]).join(count(words, "w3", "r2"), ["lang", "w3"])

    def cut_at(left: str, right: str) -> F.Column:
        wide = lambda c: f"cast({c} as decimal(18, 0))"
        return F.struct(F.expr(f"({wide('a')} * {wide('a')} * 1000000) div ({wide(left)} * {wide(right)})").alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))

    first, second = cut_at("l1", "r1"), cut_at("l2", "r2")
    two = two.select("lang", "phrase", "a", cut_at("l", "r").alias("c"))
    three = three.withColumn("c1", first).withColumn("c2", second).select("lang", "phrase", "a", F.when(F.col("c2.score") < F.col("c1.score"), F.col("c2")).otherwise(F.col("c1")).alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = two.unionByName(three).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), listed as (
    select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') as ws from pieces
), places as (
    select lang, ws, unnest(range(1, len(ws) + 1)) as i from listed
), f1 as (
    select lang, ws[i] as phrase, count(*) as f from places group by 1, 2
), f2 as (
    select lang, ws[i] || ' ' || ws[i + 1] as phrase, ws[i] as w1, ws[i + 1] as w2, count(*) as f
    from places where i < len(ws) group by all having count(*) >= 10
), f3 as (
    select lang, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as phrase, ws[i] as w1, ws[i + 2] as w3,
        ws[i] || ' ' || ws[i + 1] as p1, ws[i + 1] || ' ' || ws[i + 2] as p2, count(*) as f
    from places where i + 1 < len(ws) group by all having count(*) >= 10
), longer as (
    select lang, phrase, max(f) as longer from (select lang, p1 as phrase, f from f3 union all select lang, p2, f from f3) group by 1, 2
), cuts as (
    select t.lang, t.phrase, t.f as a, 1 as k, x.f as l, y.f as r
    from f2 t join f1 x on x.lang = t.lang and x.phrase = t.w1 join f1 y on y.lang = t.lang and y.phrase = t.w2
    left join longer g on g.lang = t.lang and g.phrase = t.phrase where not coalesce(100 * g.longer >= 50 * t.f, false)
    union all
    select t.lang, t.phrase, t.f, 1, x.f, y.f from f3 t join f1 x on x.lang = t.lang and x.phrase = t.w1 join f2 y on y.lang = t.lang and y.phrase = t.p2
    union all
    select t.lang, t.phrase, t.f, 2, x.f, y.f from f3 t join f2 x on x.lang = t.lang and x.phrase = t.p1 join f1 y on y.lang = t.lang and y.phrase = t.w3
), scored as (
    select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts
), lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), total as (select lang, sum(f)::bigint as n from f1 group by 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from lowest join total using (lang)
qualify rank <= 2000
"""
