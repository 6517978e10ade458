"""Data-quality checks, each row: check_type, table_name, dt, metric, value, rate, row_rate, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import count_where, percent, rounded

PASS_AT = {"completeness": 99.0, "uniqueness": 99.9, "validity": 99.0}
#: A passing rate below this is a warning.
WARN_BELOW = {"completeness": 99.5, "uniqueness": 99.99, "validity": 99.5}
BACKLOG = (1000, 10000)
#: Rule, check, threshold, severity, message.
ALERT_RULES = [
    ("DQ001", "completeness", 99.0, "CRITICAL", "completeness of %s is %.2f, below %.2f"),
    ("DQ002", "uniqueness", 99.9, "MAJOR", "uniqueness of %s is %.2f, below %.2f"),
    ("DQ003", "validity", 99.0, "MAJOR", "validity of %s is %.2f, below %.2f"),
    ("DQ004", "backlog", 10000.0, "CRITICAL", "backlog of %s is %.2f, above %.2f"),
]


def _result(df: DataFrame, check: str, table: str) -> DataFrame:
    status = F.when(F.col("rate").isNull(), "ERROR").when(F.col("rate") >= PASS_AT[check], "PASS").otherwise("FAIL")
    return df.select(F.lit(check).alias("check_type"), F.lit(table).alias("table_name"), "dt", "metric", "value",
        rounded(F.col("rate")).alias("rate"), rounded(F.col("row_rate")).alias("row_rate"), status.alias("status"))


def warned(results: DataFrame) -> DataFrame:
    """Check results with WARN where a rate passes by less than its warning threshold."""
    least = F.coalesce(*[F.when(F.col("check_type") == k, F.lit(v)) for k, v in WARN_BELOW.items()])
    return results.withColumn("status", F.when((F.col("status") == "PASS") & (F.col("rate") < least), "WARN").otherwise(F.col("status")))


def completeness(df: DataFrame, columns: list[str], table: str = "", dt: str = "dt") -> DataFrame:
    """rate counts a row once for each missing column, row_rate once."""
    gone = [F.col(c).isNull() for c in columns]
    missing = reduce(lambda a, b: a + b, [count_where(g) for g in gone])
    rows = df.groupBy(F.col(dt).alias("dt")).agg(missing.alias("value"), (100.0 - percent(missing, F.count("*"))).alias("rate"),
        (100.0 - percent(count_where(reduce(lambda a, b: a | b, gone)), F.count("*"))).alias("row_rate"))
    return _result(rows.withColumn("metric", F.lit("nulls")), "completeness", table)


def uniqueness(df: DataFrame, keys: list[str], table: str = "", dt: str = "dt") -> DataFrame:
    """rate counts keys that repeat, row_rate surplus rows."""
    groups = df.groupBy(F.col(dt).alias("dt"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n"))
    twice = count_where(F.col("n") > 1)
    rows = groups.groupBy("dt").agg(twice.alias("value"), (100.0 - percent(twice, F.sum("n"))).alias("rate"),
        percent(F.count("*"), F.sum("n")).alias("row_rate"))
    return _result(rows.withColumn("metric", F.lit("duplicate_keys")), "uniqueness", table)


def validity(df: DataFrame, rules: dict[str, Column], table: str = "", dt: str = "dt") -> DataFrame:
    """One row for each rule; a null counts as a breach."""
    bad = {n: ~F.coalesce(p, F.lit(False)) for n, p in rules.items()}
    any_bad = reduce(lambda a, b: a | b, bad.values())
    wide = df.groupBy(F.col(dt).alias("dt")).agg(F.count("*").alias("_all"), count_where(any_bad).alias("_any"),
        *[count_where(b).alias(n) for n, b in bad.items()])
    rows = wide.unpivot(["dt", "_all", "_any"], list(rules), "metric", "value")
    return _result(rows.withColumn("rate", 100.0 - percent(F.col("value"), F.col("_all"))).withColumn("row_rate",
        100.0 - percent(F.col("_any"), F.col("_all"))), "validity", table)


def backlog(offsets: DataFrame, table: str = "") -> DataFrame:
    """From (dt, part, end_offset, committed); value is the sum over parts, rate their mean."""
    lag = F.greatest(F.col("end_offset") - F.col("committed"), F.lit(0))
    rows = offsets.groupBy("dt").agg(F.sum(lag).cast("long").alias("value"), rounded(F.avg(lag)).alias("rate"))
    status = F.when(F.col("value") < BACKLOG[0], "PASS").when(F.col("value") < BACKLOG[1], "WARN").otherwise("FAIL")
    return rows.select(F.lit("backlog").alias("check_type"), F.lit(table).alias("table_name"), "dt", F.lit("lag").alias("metric"), "value", "rate",
        F.lit(None).cast("double").alias("row_rate"), status.alias("status"))


def report(results: DataFrame, alert_below: float = 95.0) -> DataFrame:
    """One row a day: how many checks ended how, the share that passed, whether to alert, the mean of the rates."""
    rates = F.when(F.col("check_type") != "backlog", F.col("rate").cast("decimal(10,2)"))
    rows = results.groupBy("dt").agg(*[count_where(F.col("status") == s.upper()).alias(s) for s in ("pass", "fail", "warn", "error")],
        rounded(percent(count_where(F.col("status") == "PASS"), F.count("*"))).alias("score"),
            rounded(F.sum(rates).cast("double") / F.count(rates)).alias("mean_rate"))
    return rows.withColumn("alert", F.col("score") < alert_below)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALERT_RULES, "rule_id string, check_type string, threshold double, severity string, template string")


def quality_alerts(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Rates alert below their threshold, backlogs above it."""
    rows = results.join(rules, "check_type")
    actual = F.when(F.col("check_type") == "backlog", F.col("value").cast("double")).otherwise(F.col("rate"))
    hit = F.when(F.col("check_type") == "backlog", actual > F.col("threshold")).otherwise(actual < F.col("threshold"))
    return rows.filter(hit).select("rule_id", "severity", "table_name", "dt", "metric",
        F.expr("printf(template, table_name, case when check_type = 'backlog' then cast(value as double) else rate end, threshold)").alias("message"))
