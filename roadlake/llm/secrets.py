"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control.

Base kinds (assign, access, hex) are patterns. The method adds `random`: runs
of encoded characters whose encoding is inferred (hex, base32, base36, base64;
single-case keys also in dashed groups, UUID or equal, without their dashes) and

* whose symbols pass three tests of uniform randomness at FALSE_REJECTIONS
  jointly: chi-squared over the alphabet, runs about the middle symbol, serial
  correlation at lag one; and
* whose letters are unlike those of words. The p-value of a run as text is that
  of its letters' mean log-likelihood ratio (letters of prose against uniform
  ones), whose spread shrinks with the run's length; for hex it is that of
  prose with so many letters having none but a to f. Within each class of
  encoding and length, the runs that are claimed are those that Benjamini and
  Hochberg's procedure rejects as text at FALSE_CLAIMS: of what is reported, that
  share at most is expected to be words, whether the class is short or long.

The procedure is exact on a grid of p-values (rounded up), whose counts are the
only thing that all rows share. Native: only DataFrame functions.

Places count code points, ends are exclusive. Defined results: a null or empty
text has no span; repeated rows are scanned each; an empty table gives no rows;
other columns are kept by `scan` and `redact`, which fail on a clash with their
own output names only. A text's matches are placed, merged and cut by running
sums and maxima in blocks, so the work grows little faster than their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, let, table, text_of

#: The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

#: A run of encoded characters, from its first to its last.
ENCODED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: letters: base64 in both cases without a digit; alpha: one case without a digit, for long runs only.
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/", "letters": _UPPER + _LOWER + _DIGITS + "+/", "alpha": _LOWER,
}
#: Single-case keys in groups: the layout of a UUID, or equal groups of 4 to 8.
DASHED = "^(?:" + "|".join(["X{8}-X{4}-X{4}-X{4}-X{12}", *[f"X{{{n}}}(?:-X{{{n}}}){{2,}}" for n in range(4, 9)]]).replace("X", "[C]") + ")$"
DASHED_PARTS = tuple(DASHED.replace("C", c) for c in ("0-9a-z", "0-9A-Z"))
#: From this length on runs without a digit are left to the tests whatever their cases. Shorter ones are held to have a
#: quarter of each case at least (random ones of 16 letters have it in 98 per cent), or capitalised words would pass.
LONG = 32
LEAST_BITS = 72
#: Share of truly random runs that the battery may reject, and share of the claimed ones that may be words.
FALSE_REJECTIONS, FALSE_CLAIMS = 0.001, 0.05
GRID, GRID_MOST = 20, 400
#: Per mille of the letters a to z in prose.
LETTERS = dict(zip(_LOWER, (
    82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)))
PART = 64


def before(values: Column, merge, zero: Column, levels: int = 2) -> Column:
    """For each place the values before it, merged: in parts of PART values, then over the parts likewise."""
    fold = lambda x: F.aggregate(x, zero, merge)
    short = lambda x: F.transform(x, lambda _, i: fold(F.slice(x, F.lit(1), i)))
    if not levels:
        return short(values)

    def parted(parts: Column) -> Column:
        heads = before(F.transform(parts, fold), merge, zero, levels - 1)
        return F.flatten(F.zip_with(parts, heads, lambda part, head: F.transform(short(part), lambda v: merge(head, v))))

    def split(x: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PART).cast("int")), lambda k: F.slice(x, k * PART + 1, F.lit(PART))), parted)

    return let(values, lambda x: F.when(F.size(x) > 0, split(x)).otherwise(x))


def sums_before(values: Column) -> Column:
    return before(values, lambda a, b: a + b, F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Array of struct(start, stop, found): leftmost non-overlapping matches with their places."""
    none = F.array().cast("array<struct<start:int,stop:int,found:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))  # one before each match and one after the last

    def placed(x: Column) -> Column:
        start = x["at"] + x["gap"]
        return F.struct(start.alias("start"), (start + F.length(x["found"])).alias("stop"), x["found"].alias("found"))

    def joined(x: Column) -> Column:
        ats = sums_before(F.transform(x, lambda v: v["gap"] + F.length(v["found"])))
        return F.transform(F.arrays_zip(ats.alias("at"), F.transform(x, lambda v: v["gap"]).alias("gap"), F.transform(x, lambda v: v["found"]).alias("found")), placed)

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("found")), lambda v: v["found"].isNotNull())
    return F.when(text.rlike(pattern), let(pairs, joined)).otherwise(none)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, for z of either sign (logistic form, relative error under 2 per cent to z = 4)."""
    a = F.abs(z)
    upper = 1 / (1 + F.exp(a * F.lit(1.5976) + F.pow(a, F.lit(3)) * F.lit(0.070565992)))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(x: Column) -> Column:
    """Joint p-value of the three tests, from the sums that `assess` has gathered."""
    n, k, df = x["n"], x["k"].cast("double"), x["k"].cast("double") - 1
    chi = x["squares"] * k / n - n
    cube = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    p_chi = normal_tail(cube)
    mean = 2 * x["high"] * (n - x["high"]) / n + 1
    var = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
    p_runs = F.when((x["high"] == 0) | (x["high"] == n), F.lit(1e-20)).otherwise(2 * normal_tail(F.abs((x["runs"] - mean) / F.sqrt(var))))
    p_serial = F.when(x["spread"] <= 0, F.lit(1e-20)).otherwise(2 * normal_tail(F.abs(x["lagged"] / x["spread"]) * F.sqrt(n)))
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


#: Log-likelihood ratio of each letter, prose against uniform, and its mean and deviation in prose.
_SHARE = [n / sum(LETTERS.values()) for n in LETTERS.values()]
RATIOS = [math.log(26 * p) for p in _SHARE]
_MEAN = sum(p * r for p, r in zip(_SHARE, RATIOS))
_SPREAD = math.sqrt(sum(p * (r - _MEAN) ** 2 for p, r in zip(_SHARE, RATIOS)))


def text_p(ratios: Column, n: Column) -> Column:
    """P-value of n letters with this sum of ratios as prose; 1 without letters."""
    return F.when(n > 0, normal_tail((n * _MEAN - ratios) / (_SPREAD * F.sqrt(n.cast("double"))))).otherwise(F.lit(1.0))


def plain_of(body: Column) -> tuple[Column, Column]:
    """Whether the body is a dashed key, and the body without the dashes if it is."""
    dashed = body.rlike(DASHED_PARTS[0]) | body.rlike(DASHED_PARTS[1])
    return dashed, F.when(dashed, F.translate(body, "-", "")).otherwise(body)


def encoding_of(body: Column) -> Column:
    """Name of an alphabet, from the characters that occur; null for what is not encoded."""
    digit, lower, upper = body.rlike("[0-9]"), body.rlike("[a-z]"), body.rlike("[A-Z]")
    count = lambda chars: F.length(F.regexp_replace(body, f"[^{chars}]", ""))
    return (F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$") & digit & body.rlike("[A-Fa-f]"), "hex")
            .when(body.rlike("^[A-Z2-7]+$") & digit & upper, "base32")
            .when(digit & lower & upper, "base64")
            .when(body.rlike("^([0-9a-z]+|[0-9A-Z]+)$") & digit & (lower | upper), "base36")
            .when(lower & upper & ((F.length(body) >= LONG) | ((4 * count("A-Z") >= F.length(body)) & (4 * count("a-z") >= F.length(body)))), "letters")
            .when(body.rlike("^([a-z]+|[A-Z]+)$") & (F.length(body) >= LONG), "alpha"))


def assess(spans: Column) -> Column:
    """Each span with its class and grid step; null class where there is no encoding or too short a run for one.

    Transforms in turn: a lambda's variable is written once however often it is read, so the expression stays small.
    """
    keep = lambda x, *more: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), *more)

    def inferred(x: Column) -> Column:
        dashed, body = plain_of(F.rtrim(x["found"], F.lit("=")))
        return keep(x, dashed.alias("dashed"), body.alias("body"))

    def encoded(x: Column) -> Column:
        return keep(x, x["dashed"].alias("dashed"), x["body"].alias("body"), encoding_of(x["body"]).alias("enc"))

    def coded(x: Column) -> Column:
        alphabet = F.coalesce(*[F.when(x["enc"] == e, F.lit(a)) for e, a in ALPHABETS.items()])
        plain = F.when(x["enc"].isin("hex", "base36", "alpha"), F.lower(x["body"])).otherwise(F.translate(x["body"], "-_", "+/"))
        codes = F.filter(F.transform(F.split(plain, ""), lambda c: F.position(c, alphabet) - 1), lambda v: v >= 0)
        low = F.lower(F.regexp_replace(x["body"], "[^A-Za-z]", ""))
        place = F.transform(F.split(low, ""), lambda c: F.position(c, F.lit(_LOWER)))
        # A dashed key is of a class of its own.
        return keep(
            x, F.when(x["dashed"], F.concat(x["enc"], F.lit("-"))).otherwise(x["enc"]).alias("enc"), (x["enc"] == "hex").alias("few"),
            F.length(x["body"]).alias("size"), F.length(alphabet).alias("k"), codes.alias("codes"), F.filter(place, lambda v: v > 0).alias("place"))

    def as_text(x: Column) -> Column:
        table = F.array(*map(F.lit, RATIOS))
        n = F.size(x["place"])
        words = text_p(F.aggregate(x["place"], F.lit(0.0), lambda a, v: a + F.element_at(table, v)), n)
        # That so many letters of prose all lie in a to f.
        p = F.when(x["few"], F.pow(F.lit(sum(LETTERS[c] for c in "abcdef") / sum(LETTERS.values())), n)).otherwise(words)
        return keep(x, x["enc"].alias("enc"), x["size"].alias("size"), x["k"].alias("k"), x["codes"].alias("codes"), p.alias("p_text"))

    def centred(x: Column) -> Column:
        n = F.size(x["codes"]).cast("double")
        return keep(x, x["enc"].alias("enc"), x["size"].alias("size"), x["k"].alias("k"), x["p_text"].alias("p_text"), x["codes"].alias("codes"), n.alias("n"), (F.aggregate(x["codes"], F.lit(0.0), lambda a, v: a + v) / n).alias("mid"))

    def summed(x: Column) -> Column:
        codes, mid, k = x["codes"], x["mid"], x["k"]
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        counts = F.transform(F.sequence(F.lit(0), k - 1), lambda c: F.size(F.filter(codes, lambda v: v == c)).cast("double"))
        upper = lambda v: v * 2 >= k
        return keep(
            x, x["enc"].alias("enc"), x["size"].alias("size"), k.alias("k"), x["p_text"].alias("p_text"), x["n"].alias("n"), total(F.transform(counts, lambda v: v * v)).alias("squares"),
            F.size(F.filter(codes, upper)).cast("double").alias("high"),
            F.size(F.filter(codes, lambda v, i: (i == 0) | (upper(F.get(codes, i - 1)) != upper(v)))).cast("double").alias("runs"),
            total(F.transform(codes, lambda v: (v - mid) * (v - mid))).alias("spread"),
            total(F.transform(codes, lambda v, i: F.coalesce((v - mid) * (F.get(codes, i + 1) - mid), F.lit(0.0)))).alias("lagged"))

    def judged(x: Column) -> Column:
        ok = x["size"] * F.log2(x["k"].cast("double")) >= LEAST_BITS
        return keep(x, F.when(ok, F.concat_ws(":", x["enc"], F.floor(F.log2(x["size"].cast("double"))).cast("string"))).alias("cls"), F.when(ok, battery(x)).alias("p"), x["p_text"].alias("p_text"))

    def stepped(x: Column) -> Column:
        """The step of the p-value as text; -1 where the battery rejects randomness."""
        step = F.floor(-F.log10(F.greatest(x["p_text"], F.lit(10.0 ** (-GRID_MOST / GRID)))) * GRID).cast("int")
        return keep(x, x["cls"].alias("cls"), F.when(x["p"] >= FALSE_REJECTIONS, step).otherwise(F.lit(-1)).alias("step"))

    spans = F.filter(F.transform(F.transform(spans, inferred), encoded), lambda x: x["enc"].isNotNull())
    for part in (coded, as_text, centred, summed, judged):
        spans = F.transform(spans, part)
    return F.transform(F.filter(spans, lambda x: x["cls"].isNotNull()), stepped)


def claimed_from(steps: DataFrame, share: float = FALSE_CLAIMS) -> DataFrame:
    """One row with a map from class to the least grid step that is claimed.

    Benjamini and Hochberg: the least step whose p times the class's count is within `share` of those at or beyond it.
    Runs that the battery rejects count in their class and are never claimed. steps has one row for each class and
    step: at most twelve encodings, some twenty lengths and GRID_MOST + 2 steps.
    """
    own = W.partitionBy("cls")
    held = steps.groupBy("cls", "step").agg(F.count("*").alias("n"))
    held = held.withColumn("m", F.sum("n").over(own)).withColumn("beyond", F.sum("n").over(own.orderBy(F.desc("step"))))
    p = F.pow(F.lit(10.0), -F.col("step") / F.lit(float(GRID)))
    least = held.filter((F.col("step") >= 0) & (p * F.col("m") <= F.lit(share) * F.col("beyond"))).groupBy("cls").agg(F.min("step").alias("step"))
    return least.agg(F.map_from_entries(F.collect_list(F.struct("cls", "step"))).alias("_from"))


def uncovered(runs: Column, base: Column) -> Column:
    """The runs that no base span holds whole, by one pass over both in order.

    A run that holds or overlaps a base span stays: it is the longer key of which the pattern sees a part, if the tests say so.
    """
    bare = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), F.lit("").alias("found")))
    more = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["stop"].alias("stop"), x["found"].alias("found")))

    def free(x: Column) -> Column:
        reach = before(F.transform(x, lambda v: F.when(v["kind"] < len(KINDS), v["stop"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b), F.lit(0))
        held = F.filter(F.arrays_zip(x.alias("v"), reach.alias("reach")), lambda w: (w["v"]["kind"] == len(KINDS)) & (w["reach"] < w["v"]["stop"]))
        return F.transform(held, lambda w: F.struct(w["v"]["start"].alias("start"), w["v"]["stop"].alias("stop"), w["v"]["found"].alias("found")))

    return F.when((F.size(runs) > 0) & (F.size(base) > 0), let(F.sort_array(F.concat(bare, more)), free)).otherwise(runs)


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["stop"].alias("stop")))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, share: float = FALSE_CLAIMS) -> DataFrame:
    """`keep` (default doc_id) with base and spans: arrays of struct(start, kind, stop) in order."""
    keep = keep or ["doc_id"]
    own = docs.select(*keep, text_of(text).alias("_t"))
    assigns = F.filter(matches(F.col("_t"), ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= ASSIGN_LEAST)
    own = own.select(*keep, _named("assign", assigns).alias("_a"), _named("access", matches(F.col("_t"), ACCESS)).alias("_k"), _named("hex", matches(F.col("_t"), HEX)).alias("_h"), matches(F.col("_t"), ENCODED).alias("_e"))
    own = own.select(*keep, F.sort_array(F.concat("_a", "_k", "_h")).alias("base"), "_e")
    own = own.withColumn("_e", uncovered(F.col("_e"), F.col("base"))).withColumn("_e", assess(F.col("_e")))
    own = cut(own)
    limits = claimed_from(own.select(F.explode("_e").alias("e")).select("e.cls", "e.step"), share)
    own = own.crossJoin(F.broadcast(limits))  # one row
    held = F.filter("_e", lambda x: F.coalesce(x["step"] >= F.try_element_at("_from", x["cls"]), F.lit(False)))
    return own.select(*keep, "base", F.sort_array(F.concat("base", _named("random", held))).alias("spans"))


def written(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with each span, or union of overlapping ones, replaced by `mark`; a null text stays null."""
    columns = docs.columns
    spans = scan(docs.select(F.struct(*columns).alias("_row"), text), text, keep=["_row"])
    whole = F.col(f"_row.{text}")

    def rewritten(x: Column) -> Column:
        reach = before(F.transform(x, lambda v: v["stop"]), lambda a, b: F.greatest(a, b), F.lit(0))
        pieces = F.zip_with(x, reach, lambda v, at: F.when(v["start"] >= at, F.concat(whole.substr(at + 1, v["start"] - at), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), whole.substr(F.array_max(F.transform(x, lambda v: v["stop"])) + 1, F.length(whole)))

    out = spans.select("_row", F.when(whole.isNotNull() & (F.size("spans") > 0), rewritten(F.col("spans"))).otherwise(whole).alias("_new"))
    return out.select(*[F.col("_new").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in columns])


def op7_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
