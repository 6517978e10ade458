"""Language of web pages by Bayesian fusion of several pieces of evidence.

* Text: naive Bayes over words hashed to BUCKETS, counted over all documents by
  one grouped aggregation; the log-likelihood is tempered to WORDS words, since
  words of one text are not independent.
* Declaration: P(declared markup language | language), from the pages.
* Address: the prior of a host, smoothed to that of its registered domain, that
  to the address suffix's, and that to the corpus's.
Declaration and address tables are sums of the text posteriors over all pages;
a page's own posterior is taken out of each before they speak about it, so its
text counts once, and a host of one page says what its domain says.

Defined results: a null or empty page gives no text evidence, a null url or one
without `://` the empty host; unseen values fall back to the next level; of
equal posteriors the first language in order wins; rows with a null language
train nothing; repeated rows count and are answered each; without documents the
language is null; extra columns are ignored; a declaration is a language code of
two or three letters, anything else is none. The word table has a fixed size of
BUCKETS a language, and more than MOST languages raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, table, text_of, words_of

BUCKETS = 1 << 15
MOST = 512
WORDS = 40.0
PULL = 5.0
#: Labels under a country's suffix that are not yet a registered domain.
SECOND = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
MARKUP = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]{1,8};"


def buckets_of(text: Column) -> Column:
    words = words_of(F.translate(F.lower(text), '.,;:!?"()|#$%&*', " " * 15))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def word_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and log P(bucket | language), add-one smoothed, as (BUCKETS, languages)."""
    counts = docs.filter("lang is not null").select("lang", F.explode(buckets_of(text_of())).alias("bucket")).groupBy("lang", "bucket").agg(F.count("*").alias("n"))
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(MOST + 1).toArrow()  # at most BUCKETS a language
    if rows.num_rows > MOST:
        raise ValueError("more languages than the bound")
    names = rows["lang"].to_pylist()
    langs = sorted(names)
    model = np.ones((BUCKETS, max(1, len(langs))))
    for lang, c in zip(names, rows["c"]):
        model[c.values.field("bucket").to_numpy(), langs.index(lang)] += c.values.field("n").to_numpy()
    return langs, np.log(model / model.sum(axis=0)).astype(np.float32)


def text_evidence(buckets: Column, model: np.ndarray, spark: SparkSession) -> Column:
    """Tempered log-likelihood of each language."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out = []
            for b in rows:
                ll = shared.value[b].sum(axis=0, dtype=np.float64) * min(1.0, WORDS / len(b)) if b is not None and len(b) else np.zeros(shared.value.shape[1])
                out.append((ll - ll.max()).tolist())
            yield pd.Series(out, dtype=object)

    return run(buckets)


def normalised(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def posterior(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, host of every page."""
    spark = pages.sparkSession
    langs, model = word_model(docs)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("host"))
    k, names = len(langs), F.array(*map(F.lit, langs))
    url, html = F.coalesce(F.col("url").cast("string"), F.lit("")), text_of("html")
    host = F.lower(F.regexp_extract(url, r"^(?s:.*?)://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = pages.select(
        "page_id", host.alias("host"), F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})(?![a-z])""", 1)).alias("declared"),
        text_evidence(buckets_of(F.regexp_replace(html, MARKUP, " ")), model, spark).alias("ll"))
    labels = F.split("host", r"\.")
    second = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND)
    suffix = F.when(second, F.substring_index("host", ".", -2)).otherwise(F.substring_index("host", ".", -1))
    domain = F.when(second, F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2))
    own = cut(own.withColumn("domain", domain).withColumn("suffix", suffix).withColumn("g", normalised(F.col("ll"))))
    sums = [F.sum(F.get("g", F.lit(i))).alias(f"s{i}") for i in range(k)]
    total = F.array(*[F.col(f"s{i}") for i in range(k)])

    def counted(name: str, *keys: str) -> DataFrame:
        """The sum of the posteriors for each key, as array `name`."""
        return own.groupBy(*keys).agg(*sums).select(*keys, total.alias(name))

    root = F.broadcast(counted("all"))  # one row
    hosts = cut(counted("of_host", "suffix", "domain", "host"))
    up = lambda name: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(k)])
    domains = cut(hosts.groupBy("suffix", "domain").agg(up("of_host").alias("of_domain")))
    suffixes = domains.groupBy("suffix").agg(up("of_domain").alias("of_suffix"))
    hosts = cut(hosts.join(domains.join(suffixes, "suffix").drop("suffix"), "domain").select("host", "of_host", "of_domain", "of_suffix"))
    # At most all codes of two or three letters.
    told = F.broadcast(cut(counted("of_told", "declared").filter("declared <> ''")))
    out = own.join(hosts, "host").join(told, "declared", "left").crossJoin(root)
    rest = lambda a: F.zip_with(a, "g", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    share = lambda a: let(a, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda p, q: p + q)))

    def pulled(name: str, upper: str) -> Column:
        """The shares without the page, pulled to those of the level above with the weight of PULL pages."""
        return share(F.zip_with(rest(F.col(name)), upper, lambda x, y: x + PULL * y))

    out = out.withColumn("others", rest(F.col("all"))).withColumn("p0", share(F.transform("others", lambda x: x + 1.0)))
    out = out.withColumn("p1", pulled("of_suffix", "p0")).withColumn("p2", pulled("of_domain", "p1")).withColumn("prior", pulled("of_host", "p2"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q)
    out = out.withColumn("seen", rest(F.col("of_told"))).withColumn("rate", PULL * add(F.col("seen")) / F.greatest(add(F.col("others")), F.lit(1e-9)))
    says = F.zip_with("seen", "others", lambda x, y: F.log((x + F.col("rate") + 1e-9) / (y + PULL)))
    log = F.zip_with(F.zip_with("ll", "prior", lambda x, y: x + F.log(y)), F.coalesce(says, F.array_repeat(F.lit(0.0), k)), lambda x, y: x + y)
    out = out.select("page_id", "host", "declared", "g", normalised(log).alias("p"))
    top = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return out.select("page_id", top(F.col("p")).alias("lang"), F.array_max("p").alias("probability"), top(F.col("g")).alias("text_lang"), "declared", "host")


def op9_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
