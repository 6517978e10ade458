"""Golden cases and invariants of the operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadlake.functions import columns
from roadlake.operators import alerts, clean, dims, joins, lineage, quality, series, skew
from roadlake.operators.anomaly import IForest, average_depth, device_anomaly, flow_anomaly, score_at_rank
from roadlake.streaming import jobs

ROAD = "road_id string, speed_limit int, lanes int"


def roads(spark, rows):
    return spark.createDataFrame(rows, ROAD)


def test_scd2_three_days(spark):
    """One key missing from a source stays open; edits close and open; closed rows are carried forward."""
    day1 = [(f"R{i}", 100 + i, 4) for i in range(1, 6)]
    day2 = [("R1", 90, 4), ("R2", 102, 4), ("R3", 103, 6), ("R4", 104, 4), ("R5", 105, 4), ("R6", 80, 2)]
    day3 = [("R1", 90, 4), ("R2", 102, 8), ("R3", 103, 6), ("R4", 104, 4), ("R5", 105, 4), ("R6", 80, 2)]
    one = dims.scd2_init(roads(spark, day1), "2026-06-07")
    two = dims.scd2_merge(one, roads(spark, day2), "road_id", ["speed_limit", "lanes"], "2026-06-08")
    assert two.filter("is_current = 'Y'").count() == 6 and two.filter("is_current = 'N'").count() == 2
    three = dims.scd2_merge(two, roads(spark, day3), "road_id", ["speed_limit", "lanes"], "2026-06-09")
    assert three.filter("is_current = 'Y'").count() == 6 and three.filter("is_current = 'N'").count() == 3
    assert {(r.road_id, r.end_time) for r in three.filter("is_current = 'N'").collect()} == {("R1", "2026-06-07"), ("R3", "2026-06-07"), ("R2", "2026-06-08")}
    assert all(r.violations == 0 for r in dims.scd2_check(three, "road_id", roads(spark, day3), ["speed_limit", "lanes"]).collect())


def test_scd2_null_changes_and_deletes(spark):
    one = dims.scd2_init(roads(spark, [("A", None, 1), ("B", 1, 1), ("C", 1, 1)]), "2026-01-01")
    out = dims.scd2_merge(one, roads(spark, [("A", 5, 1), ("B", 1, 1)]), "road_id", ["speed_limit"], "2026-01-02", roads(spark, [("C", 0, 0)]))
    got = {(r.road_id, r.is_current, r.speed_limit) for r in out.collect()}
    assert got == {("A", "N", None), ("A", "Y", 5), ("B", "Y", 1), ("C", "N", 1)}


def test_scd2_from_cdc(spark):
    one = dims.scd2_init(roads(spark, [("A", 1, 1), ("B", 1, 1)]), "2026-01-01")
    changes = spark.createDataFrame([("update", 1, 1, "A", 7, 1), ("update", 2, 1, "A", 9, 1), ("delete", 1, 1, "B", 1, 1), ("insert", 1, 1, "C", 3, 3)], f"type string, ts long, xoffset long, {ROAD}")
    got = {(r.road_id, r.is_current, r.speed_limit) for r in dims.scd2_from_cdc(one, changes, "road_id", ["speed_limit"], "2026-01-02").collect()}
    assert got == {("A", "N", 1), ("A", "Y", 9), ("B", "N", 1), ("C", "Y", 3)}


def test_dedup_is_total(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, "x"), ("a", 2, "y"), (None, 1, "z")], "k string, t int, v string")
    assert sorted(map(tuple, clean.dedup(df, ["k", "t"]).collect()), key=str) == sorted([("a", 1, None), ("a", 2, "y"), (None, 1, "z")], key=str)


def _times(spark, rows):
    base = dt.datetime(2026, 6, 8, 10)
    return spark.createDataFrame([(k, base + dt.timedelta(seconds=s), v) for k, s, v in rows], "k string, ts timestamp, v string")


def test_sequence_overlaps_and_limit(spark):
    df = _times(spark, [("d", s, "OFFLINE") for s in (0, 60, 120, 170)] + [("e", 0, "OFFLINE"), ("e", 90, "OFFLINE"), ("e", 180, "OFFLINE")])
    hits = series.sequence(df, "k", "ts", F.col("v") == "OFFLINE", 3, 180)
    assert sorted(r.k for r in hits.collect()) == ["d", "d"]
    assert series.sequence(df, "k", "ts", F.col("v") == "OFFLINE", 3, 180, first_only=True).count() == 1


def test_suppression_counts_from_last_sent(spark):
    df = _times(spark, [("a", 60 * m, str(m)) for m in (0, 20, 40, 60, 71)])
    got = [r.sent for r in alerts.suppress(df, "k", "ts", 30).orderBy("ts").collect()]
    assert got == [True, False, True, False, True]


def test_flow_spike_needs_warm_up(spark):
    df = spark.createDataFrame([("r", i, f) for i, f in enumerate([10, 10, 10, 30, 10, 10, 40])] + [(None, 1, 5)], "k string, i int, f int")
    got = series.flow_spike(df, "k", "i", "f").collect()
    assert [r.i for r in got] == [6] and got[0].flow == 40


def test_salted_forms_equal_plain_ones(spark):
    df = spark.range(2000).select((F.col("id") % 7).alias("k"), (F.col("id") % 13).alias("v"))
    plain = {(r.k, r.s) for r in df.groupBy("k").agg(F.sum("v").alias("s")).collect()}
    assert {(r.k, r.s) for r in skew.salted_agg(df, ["k"], {"s": F.col("v")}).collect()} == plain
    dim = spark.createDataFrame([(i, str(i)) for i in range(7)], "k long, name string")
    assert joins.salted_join(df, dim, "k", [0, 1]).count() == 2000


def test_salted_join_refuses_what_it_would_repeat(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    two = one.withColumnRenamed("v", "w")
    for how, n in (("inner", 2), ("left", 2), ("left_semi", 2), ("left_anti", 0)):
        assert joins.salted_join(one, two, "k", [1], how=how).count() == n
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            joins.salted_join(one, two, "k", [1], how=how)


def test_gini_bounds(spark):
    even = spark.range(100).select((F.col("id") % 10).alias("k"))
    assert abs(skew.gini(even, "k").first()[0]) < 1e-9
    lone = spark.createDataFrame([(0,)] * 997 + [(1,), (2,), (3,)], "k int")
    assert skew.gini(lone, "k").first()[0] > 0.99


def test_lineage_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("z", "a")], "src string, dst string")
    assert {(r.table_name, r.type) for r in lineage.impact(edges, "a").collect()} == {("b", "DIRECT"), ("c", "INDIRECT"), ("a", "INDIRECT")}
    assert {r.path for r in lineage.trace(edges, "b", "x").collect()} == {"b <- a <- z"}


def test_lineage_of_layers_and_long_chains(spark):
    layers = [(f"l{i}_{a}", f"l{i + 1}_{b}") for i in range(8) for a in range(6) for b in range(6)]
    got = {r.table_name: r.depth for r in lineage.downstream(spark.createDataFrame(layers, "src string, dst string"), "l0_0").collect()}
    assert got == {f"l{i}_{b}": i for i in range(1, 9) for b in range(6)}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "src string, dst string")
    assert {r.table_name: r.depth for r in lineage.upstream(chain, "n40").collect()} == {f"n{i}": 40 - i for i in range(40)}
    assert lineage.downstream(chain, "n0", max_depth=7).count() == 7
    assert lineage.downstream(chain, "nowhere").count() == 0


def test_quality_counts_once_and_per_column(spark):
    df = spark.createDataFrame([(None, None, "d"), ("a", "b", "d")], "x string, y string, dt string")
    r = quality.completeness(df, ["x", "y"], "t").first()
    assert (r.value, r.rate, r.row_rate, r.status) == (2, 0.0, 50.0, "FAIL")


def test_forest_finds_the_outlier(spark):
    df = spark.createDataFrame([(i, 40.0 + i % 7, 50.0 + i % 5, 30.0 + i % 3) for i in range(200)] + [(999, 99.0, 99.0, 95.0), (1000, None, 1.0, 1.0)], "device_id long, cpu double, mem double, temp double")
    out = IForest(n=50, seed=3).fit(df, ["cpu", "mem", "temp"]).score(df).collect()
    best = max((r for r in out if r.score is not None), key=lambda r: r.score)
    assert best.device_id == 999 and all(r.score is None or 0 < r.score <= 1 for r in out)
    assert sum(r.is_anomaly for r in out) <= 10
    few = device_anomaly(df.limit(6))
    assert few.filter("is_anomaly").count() == 0


def plain_length(node, nodes, x, depth=0):
    column, cut, low, high = nodes[node]
    return cut if column < 0 else plain_length(int(low) if x[int(column)] < cut else int(high), nodes, x, depth + 1)


def test_forest_by_plain_walks(spark):
    """Scores and the limit against a walk of every row through every tree, whatever the layout of the input."""
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(0, 1, 2).round(1))) for i in range(400)] + [(900 + i, 0.0, 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    forest = IForest(n=20, sample=64, contamination=0.1, seed=5).fit(df, ["a", "b"])
    again = IForest(n=20, sample=64, contamination=0.1, seed=5).fit(df.repartition(7), ["a", "b"])
    assert all(np.array_equal(x, y) for x, y in zip(forest.trees, again.trees)) and forest.size == 64
    got = {r.id: (r.score, r.is_anomaly) for r in forest.score(df).collect()}
    want = {i: round(2 ** (-np.mean([plain_length(0, t, x) for t in forest.trees]) / average_depth(64)), 12) for i, *x in rows}
    assert all(abs(got[i][0] - want[i]) < 1e-11 for i in want)
    limit = sorted((s for s, _ in got.values()), reverse=True)[49]
    assert all(bad == (s > limit) for s, bad in got.values()) and 0 < sum(bad for _, bad in got.values()) < 50


def test_flow_and_device_anomalies(spark):
    """Too few rows have no anomaly; the odd hour and the hot device are found, with the cause in its fixed order."""
    flows = [(h % 24, 100 + h % 5) for h in range(200)] + [(3, 5000)]
    df = spark.createDataFrame(flows, "hour int, flow int")
    assert flow_anomaly(df.limit(23)).filter("is_anomaly or score is not null").count() == 0
    out = flow_anomaly(df, trees=30, contamination=0.02)
    assert out.filter("flow = 5000").first().is_anomaly and out.filter("is_anomaly").count() <= 3
    rows = [(40.0 + i % 9, 50.0 + i % 7, 30.0 + i % 5) for i in range(150)]
    odd = [(99.0, 99.0, 99.0), (99.0, 99.0, 20.0), (10.0, 99.0, 20.0), (0.0, 0.0, 0.0)]
    got = device_anomaly(spark.createDataFrame(rows + odd, "cpu double, mem double, temp double"), trees=60, contamination=0.05).collect()
    causes = {(r.cpu, r.mem, r.temp): r.cause for r in got if r.is_anomaly}
    assert [causes.get(x) for x in odd] == ["TEMP_HIGH", "CPU_HIGH", "MEMORY_HIGH", "COMBINED"]
    assert all(r.cause is None for r in got if not r.is_anomaly)


def test_forest_on_few_values_and_many_rows(spark):
    """Rows of one value that are most of the input do not fill a tree's group beyond its share."""
    df = spark.range(30000).select(F.when(F.col("id") < 29000, 0.0).otherwise(F.col("id") % 50 + 1.0).alias("a"))
    forest = IForest(n=5, sample=32, seed=1).fit(df, ["a"])
    assert len(forest.trees) == 5 and forest.size == 32


def test_score_at_rank(spark):
    v = [0.5, 0.5, 1.0, 0.123456789012, 0.123456789011, 0.0]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "score double")
    assert [score_at_rank(df, k) for k in (1, 2, 3, 4, 5, 6)] == sorted(v, reverse=True) and score_at_rank(df, 7) is None


def test_long_histories_are_cut_without_loss(spark):
    """Matches, gaps, spikes and silences across the ends of the blocks of time that a key is dealt by."""
    rng = np.random.default_rng(4)
    base = dt.datetime(2026, 6, 7, 23)
    at = sorted({int(x) for x in rng.integers(0, 90000, 700)})
    rows = [("d", base + dt.timedelta(seconds=s), "OFFLINE" if rng.random() < 0.8 else "ONLINE", float(rng.integers(1, 9))) for s in at]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v string, f double")
    times, states = [r[1] for r in rows], [r[2] for r in rows]
    want = {(times[i - 2], times[i]) for i in range(2, len(rows)) if states[i - 2 : i + 1] == ["OFFLINE"] * 3 and (times[i] - times[i - 2]).total_seconds() < 400}
    assert {(r.first_ts, r.last_ts) for r in series.sequence(df, "k", "ts", F.col("v") == "OFFLINE", 3, 400).collect()} == want
    pauses = {(a, b) for a, b in zip(times, times[1:]) if (b - a).total_seconds() > 240}
    assert {(r.gap_start, r.gap_end) for r in series.gaps(df, "k", "ts", 4).collect()} == pauses
    state, spikes = None, []
    for _, t, _, f in rows:
        state, hit = series.spike_step(state, f, 0.2, 1.5, 5)
        spikes += [(t, round(hit, 9))] if hit is not None else []
    by_hour = series.flow_spike(df, "k", "ts", "f", factor=1.5, block=series.blocks("ts", 3600))
    assert sorted((r.ts, round(r.history_avg, 9)) for r in by_hour.collect()) == spikes and spikes
    stretches, begun = set(), None
    for i, (t, v) in enumerate(zip(times, states)):
        begun = (begun if begun is not None else i) if v == "OFFLINE" else None
        if begun is not None and (i + 1 == len(times) or states[i + 1] != "OFFLINE") and (t - times[begun]).total_seconds() > 600:
            stretches.add((times[begun], t, i - begun + 1))
    assert {(r.start_ts, r.end_ts, r.n) for r in series.sustained(df, "k", "ts", F.col("v") == "OFFLINE", (10, 60)).collect()} == stretches and stretches
    always = series.sustained(df, "k", "ts", F.lit(True)).collect()
    assert [(r.start_ts, r.end_ts, r.n, r.level) for r in always] == [(times[0], times[-1], len(times), "CRITICAL")]
    assert series.sustained(df, "k", "ts", F.lit(False)).count() == 0
    last, sent = None, set()
    for t in times:
        if last is None or (t - last).total_seconds() >= 600:
            last = t
            sent.add(t)
    assert {r.ts for r in alerts.suppress(df, "k", "ts", 10).filter("sent").collect()} == sent


def sent_by_fold(rows, minutes):
    """(key, time) sent, by one fold over each key's times."""
    last, out = {}, set()
    for k, t in sorted(set(rows), key=lambda r: (str(r[0]), r[1])):
        if k not in last or (t - last[k]).total_seconds() >= 60 * minutes:
            last[k] = t
            out.add((k, t))
    return out


@pytest.mark.parametrize("minutes", [1, 7, 30, 700])
def test_suppression_by_pointers_equals_one_fold(spark, monkeypatch, minutes):
    """A key with an alert each minute for 70 days, sparse ones, pauses of days, times to the microsecond, a null key."""
    monkeypatch.setattr(alerts, "BLOCK_TIMES", 500)
    rng = np.random.default_rng(minutes)
    start = dt.datetime(2026, 1, 1)
    rows = [("each", start + dt.timedelta(minutes=m)) for m in range(100_800)]
    for k in ("a", "b", "c", None):
        at = np.cumsum(rng.choice([0.4, 3, 29, 30, 31, 500, 5000], 900, p=[0.3, 0.3, 0.15, 0.1, 0.1, 0.04, 0.01]) + rng.integers(0, 3, 900) * 1e-8)
        rows += [(k, start + dt.timedelta(minutes=float(m))) for m in at]
    rows += [("twice", start), ("twice", start), ("edge", start), ("edge", start + dt.timedelta(minutes=minutes)), ("near", start), ("near", start + dt.timedelta(minutes=minutes, microseconds=-1))]
    got = alerts.suppress(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", minutes).filter("sent").collect()
    want = sent_by_fold(rows, minutes)
    assert {(r.k, r.ts) for r in got} == want and len(got) == len(want)


def test_paths_of_a_block():
    times = np.array([0, 1, 4, 9, 10, 15, 30])
    assert [p.tolist() for p in alerts._paths(times, 0, 5)] == [[0, 9, 15, 30], [1, 9, 15, 30], [4, 9, 15, 30], [9, 15, 30]]


def test_suppression_of_ties_and_nulls(spark):
    t = dt.datetime(2026, 6, 8, 10)
    df = spark.createDataFrame([("a", t, 1), ("a", t, 2), (None, t, 3), ("a", None, 4), (None, None, 5)], "k string, ts timestamp, v int")
    got = alerts.suppress(df, "k", "ts").collect()
    assert len(got) == 5 and sum(r.sent for r in got if r.k == "a" and r.ts) == 1 and all(r.sent for r in got if r.v >= 3)


def test_escalation_and_routing(spark):
    df = spark.createDataFrame([("1", "MAJOR", dt.datetime(2026, 6, 8, 2, 30), "UNRECOVERED", "2026-06-08"), ("2", "CRITICAL", dt.datetime(2026, 6, 8, 2, 30), "RECOVERED", "2026-06-08")], "alarm_id string, severity string, alarm_time timestamp, recover_status string, dt string")
    policy = alerts.policy_table(spark)
    assert [(r.alarm_id, r.severity, r.was) for r in alerts.escalate(df, policy, "2026-06-08 04:00:00").collect()] == [("1", "CRITICAL", "MAJOR")]
    assert alerts.route(df, policy).count() == 5
    assert [r.alarm_id for r in alerts.in_window(df).collect()] == ["2"]


@pytest.mark.parametrize("n,more", [(3, 2), (10, 0)])
def test_digest(spark, n, more):
    df = _times(spark, [("a", s, str(s)) for s in range(5)])
    r = alerts.digest(df, ["k"], "ts", "v", n).first()
    assert r.more == more and r.items.split(",")[0] == "4"


@pytest.mark.parametrize("rows, size", [(5, 6), (3, 4096), (9, 4)])
def test_moving_average_over_block_ends(spark, rows, size):
    """Equal to one window a key: over ends of days and of numbered blocks, sparse keys, equal times, nulls."""
    rng = np.random.default_rng(rows)
    start = dt.datetime(2026, 1, 1)
    data = [("hot", start + dt.timedelta(minutes=int(m)), int(v)) for m, v in zip(rng.integers(0, 20_000, 400), rng.integers(0, 90, 400))]
    data += [("sparse", start + dt.timedelta(days=40 * i), i) for i in range(12)] + [(None, start, 4), (None, start + dt.timedelta(days=2), None), ("hot", None, 7)]
    df = spark.createDataFrame(data, "k string, ts timestamp, v int")
    got = series.moving_avg(df, ["k"], "ts", "v", rows, size=size)
    own = W.partitionBy("k").orderBy(F.col("ts").asc_nulls_first(), F.xxhash64(*df.columns)).rowsBetween(1 - rows, 0)
    want = df.withColumn("moving_avg", columns.rounded(F.sum("v").over(own).cast("double") / F.count("v").over(own)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    numbers = df.withColumn("n", F.unix_timestamp("ts"))
    assert sorted(map(str, series.moving_avg(numbers, ["k"], "n", "v", rows, size=size).drop("n").collect())) == sorted(
        map(str, numbers.withColumn("moving_avg", columns.rounded(F.sum("v").over(_by(numbers, rows)).cast("double") / F.count("v").over(_by(numbers, rows)))).drop("n").collect()))
    with pytest.raises(ValueError):
        series.moving_avg(df, ["k"], "k", "v")


def _by(df, rows):
    return W.partitionBy("k").orderBy(F.col("n").asc_nulls_first(), F.xxhash64(*df.columns)).rowsBetween(1 - rows, 0)


def test_history_over_block_ends(spark):
    rng = np.random.default_rng(3)
    data = [("R", str(dt.date(2025, 1, 1) + dt.timedelta(days=int(d))), int(h), int(f)) for d in range(120) for h in (7, 8) for f in rng.choice([10, 11, 40], 1) if rng.random() < 0.7]
    df = spark.createDataFrame(data, "road_id string, dt string, hour int, flow int")
    day = F.datediff(F.col("dt").cast("date"), F.lit("1970-01-01"))
    own = W.partitionBy("road_id", "hour").orderBy(day).rangeBetween(-7, -1)
    plain = df.withColumn("h", F.avg("flow").over(own)).filter(F.col("flow") > 2 * F.col("h"))
    got = series.vs_history(df, "road_id", "dt", "hour", "flow", span=10)
    assert sorted((r.dt, r.hour) for r in got.collect()) == sorted((r.dt, r.hour) for r in plain.collect()) and got.count() > 10


def test_minute_keeps_its_first_row(spark):
    rows = [("D", "R", "S", 500, dt.datetime(2026, 6, 8, 10, 0, 9)), ("D", "R", "S", 50, dt.datetime(2026, 6, 8, 10, 0, 8)), ("D", None, "S", 50, dt.datetime(2026, 6, 8, 10, 0, 8))]
    for some in (rows, rows[::-1]):
        out = jobs.dedup_minute(spark.createDataFrame(some, "device_id string, road_id string, vehicle_type string, speed int, pass_time timestamp")).collect()
        assert sorted((str(r.road_id), r.speed, r.is_valid) for r in out) == [("None", 50, False), ("R", 50, True)]


def test_forest_by_joins_equals_the_arrow_path(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, *map(float, rng.normal(50, 10, 3))) for i in range(300)] + [(300, 500.0, 0.0, 50.0), (301, None, 1.0, 1.0), (302, float("nan"), 1.0, 1.0)], "i int, cpu double, mem double, temp double")
    forest = IForest(12, 64, 0.05, seed=3).fit(df.filter("i < 300"), ["cpu", "mem", "temp"])
    want = {r.i: r for r in forest.score(df).collect()}
    got = {r.i: r for r in forest.score_by_joins(df).collect()}
    assert set(got) == set(want) == set(range(303))
    assert all((got[i].score is None) == (want[i].score is None) and (want[i].score is None or abs(got[i].score - want[i].score) < 2e-6) for i in want)
    assert got[300].is_anomaly and not got[301].is_anomaly and got[301].score is None and got[302].score is None
