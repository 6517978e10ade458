"""Quality rules: one threshold table compiled into one Spark projection.

Each row of RULES names a measure, the least and the greatest value that a
document may have. `verdict` turns the table into a single boolean column; no
Python runs on the executors.

Defined results: a null or empty text has no words, so every count is 0,
base_failed is true and kept false. Repeated rows are judged one by one. Extra
columns of the input are ignored. A text with fewer than eight words has no
window. Cost is O(n log n) in the words of a text, whatever repeats in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, table, text_of, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it with as was on are be by this an at or a from "
    "der die und in den von zu das mit sich auf für ist nicht ein eine dem des im auch "
    "de la le et les des en un une du dans que pour est sur par au qui ne pas "
    "el los las del y se por con una su para al lo como"
).split()

#: measure, least, greatest (None: no bound).
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 20, None),
    ("mean_word_length", 2, 12),
    ("symbols_per_word", None, 0.1),
    ("stop_word_share", 0.06, None),
    ("dup_line_share", None, 0.3),
    ("repeat_word_share", None, 0.3),
    ("shout_share", None, 0.5),
    ("bullet_line_share", None, 0.9),
    ("ellipsis_line_share", None, 0.3),
]


def verdict(rules: list[tuple[str, float | None, float | None]]) -> Column:
    """The table as one column: true where every measure keeps its bounds."""
    ok = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            ok = ok & (F.col(name) >= F.lit(float(least)))
        if most is not None:
            ok = ok & (F.col(name) <= F.lit(float(most)))
    return ok


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) with counts and ratios of each whole text."""
    keep = ["doc_id"] if keep is None else keep
    own = docs.select(*keep, text_of(text).alias("_t"))
    own = own.select(
        *keep,
        words_of(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.translate(x, WHITE, "") != "").alias("_lines"),
        F.length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    grams = F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))
    own = own.select(
        *keep, "word_chars", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))).alias("_bullets"),
        F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("_dots"),
        F.size(F.filter("_w", lambda x: F.rtrim(F.lower(x), F.lit(".,;:!?")).isin(*STOP_WORDS))).alias("_stops"),
        F.size(F.filter("_w", lambda x: (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 1))).alias("_loud"),
        F.when(F.size("_w") >= WINDOW, grams).alias("_g"),
    )
    # Only texts with a repeated window are sorted; the window's places follow its hash.
    placed = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    own = own.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), placed))
    twice = F.filter("_s", lambda x, i: F.get("_s", i - 1)["h"].eqNullSafe(x["h"]) | F.get("_s", i + 1)["h"].eqNullSafe(x["h"]))
    own = own.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["p"]))).drop("_g", "_s")
    cover = F.aggregate(
        F.transform("_p", lambda p, i: F.coalesce(F.least(F.get("_p", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    own = own.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long")))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))
    return own.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        per("word_chars", "n_words").alias("mean_word_length"),
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("_stops", "n_words").alias("stop_word_share"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"),
        per("n_repeat_words", "n_words").alias("repeat_word_share"),
        per("_loud", "n_words").alias("shout_share"),
        per("_bullets", "n_lines").alias("bullet_line_share"),
        per("_dots", "n_lines").alias("ellipsis_line_share"),
    )


def judge(docs: DataFrame, rules: list[tuple[str, float | None, float | None]] = RULES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Measures plus base_failed and kept."""
    m = measures(docs, text, keep)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select r, unnest(range(1, len(w) - 6)) as p, w from w where len(w) >= 8),
h as (select r, p, array_to_string(w[p:p + 7], ' ') as g from g),
c as (select r, p, count(*) over (partition by r, g) as n from h),
x as (select r, p, lead(p) over (partition by r order by p) as q from c where n > 1),
y as (select r, sum(least(8, coalesce(q - p, 8))) as rep from x group by r),
m as (select w.doc_id, len(w)::bigint as n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep, 0)::bigint as n_repeat_words,
  len(lines)::bigint as n_lines,
  len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') in ({_STOPS})))::bigint as stops,
  len(list_filter(w, lambda x: upper(x) = x and lower(x) <> x and length(x) > 1))::bigint as loud,
  len(list_filter(lines, lambda x: ltrim(x, ' ')[1] in ('-', '*', '•')))::bigint as bullets,
  len(list_filter(lines, lambda x: rtrim(x, ' ') like '%...' or rtrim(x, ' ') like '%…'))::bigint as dots
  from w left join y using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  case when n_words > 0 then n_words::double else 1 end as nw, case when n_lines > 0 then n_lines::double else 1 end as nl from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words >= 20 and word_chars / nw between 2 and 12 and n_symbols / nw <= 0.1::double
  and stops / nw >= 0.06::double and n_dup_lines / nl <= 0.3::double and n_repeat_words / nw <= 0.3::double
  and loud / nw <= 0.5::double and bullets / nl <= 0.9::double and dots / nl <= 0.3::double as kept
from b
"""
