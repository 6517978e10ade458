"""Each stream job against its batch twin over a file stream."""

import datetime as dt
import json
import shutil
import time

import pytest
from pyspark.sql import functions as F

from roadlake.operators import alerts, dims, series
from roadlake.plans import registry_rules
from roadlake.sources import io
from roadlake.streaming import jobs, rules, stateful

BASE = dt.datetime(2026, 6, 8, 10)
FAR = dt.datetime(2026, 6, 9, 10)


def stream_of(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(path))


def collected(spark, stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_window_counts(spark, tmp_path):
    schema = "road_id string, device_id string, vehicle_type string, speed int, pass_time timestamp"
    rows = [("R1", "D", "S", 10 * i, BASE + dt.timedelta(seconds=90 * i)) for i in range(8)]
    s = stream_of(spark, tmp_path / "in", [rows[:4], rows[4:], [("Z", "D", "S", 1, FAR)]], schema)
    got = collected(spark, jobs.road_counts(s), "counts", tmp_path)
    want = jobs.road_counts(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streamed_input_is_computed_once(spark):
    """A query over a stream writes its input once; its closing rows take their time from what was written."""
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [("R1", 10 * i, BASE + dt.timedelta(seconds=90 * i)) for i in range(8)] + [(None, 5, BASE), ("R2", None, FAR)]
    df = spark.createDataFrame(rows, "road_id string, speed int, pass_time timestamp").coalesce(1)
    got = registry_rules._streamed(df.mapInPandas(noted, df.schema), "pass_time", "road_id", jobs.road_counts)
    key = lambda r: (r[0], r[1] or "")
    want = [r for r in jobs.road_counts(df).collect() if r.road_id]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want), key=key)
    assert seen.value == len(rows)


def test_sequence_rules_in_event_order(spark, tmp_path):
    schema = "k string, ts timestamp, v string"
    at = lambda s: BASE + dt.timedelta(seconds=s)
    one = [("d", at(60), "OFFLINE"), ("d", at(0), "OFFLINE"), ("e", at(0), "ONLINE"), ("e", at(30), "OFFLINE")]
    two = [("d", at(50), "OFFLINE"), ("d", at(110), "OFFLINE"), ("e", at(70), "OFFLINE")]
    s = stream_of(spark, tmp_path / "in", [one, two, [("z", FAR, "x")], [("z", FAR + dt.timedelta(hours=1), "x")]], schema)
    off = F.col("v") == "OFFLINE"
    out = stateful.sequence_stream(s, "k", "ts", {"off3": (off, 3, 180), "off2": (off, 2, 45)})
    got = collected(spark, out, "rules", tmp_path)
    batch = spark.createDataFrame(one + two, schema)
    for rule, n, within in (("off3", 3, 180), ("off2", 2, 45)):
        want = {tuple(r) for r in series.sequence(batch, "k", "ts", off, n, within).select("k", "first_ts", "last_ts").collect()}
        assert {tuple(r) for r in got.filter(F.col("rule") == rule).select("key", "first_ts", "last_ts").collect()} == want
        assert want


def test_flow_spike_equals_fold(spark, tmp_path):
    schema = "k string, ts timestamp, f double"
    rows = [("r", BASE + dt.timedelta(minutes=i), float(f)) for i, f in enumerate([10, 11, 9, 10, 12, 10, 50, 10, 45])]
    s = stream_of(spark, tmp_path / "in", [rows[:5], rows[5:], [("z", FAR, 1.0)], [("z", FAR + dt.timedelta(hours=1), 1.0)]], schema)
    got = collected(spark, stateful.flow_spike_stream(s, "k", "ts", "f"), "spikes", tmp_path)
    want = series.flow_spike(spark.createDataFrame(rows, schema), "k", "ts", "f")
    key = lambda r: (r.ts, round(r.history_avg, 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and want.count() == 2


def test_dedup_minute(spark, tmp_path):
    schema = "road_id string, device_id string, vehicle_type string, speed int, pass_time timestamp"
    rows = [("R1", "D", "S", 10, BASE), ("R1", "D", "S", 20, BASE + dt.timedelta(seconds=5)), ("R1", "D", "S", 999, BASE + dt.timedelta(seconds=65))]
    s = stream_of(spark, tmp_path / "in", [rows], schema)
    got = collected(spark, jobs.dedup_minute(s), "minute", tmp_path)
    assert got.count() == 2 and got.filter("not is_valid").count() == 1


def test_latest_view_and_late_rows(spark, tmp_path):
    schema = "road_id string, n int, update_time timestamp"
    sink = jobs.upsert_latest(str(tmp_path / "view"), "road_id", "update_time")
    sink(spark.createDataFrame([("R1", 1, BASE), ("R2", 1, BASE)], schema), 0)
    sink(spark.createDataFrame([("R1", 5, BASE + dt.timedelta(minutes=20))], schema), 1)
    sink(spark.createDataFrame([("R1", 5, BASE + dt.timedelta(minutes=20))], schema), 1)
    got = jobs.read_latest(spark, str(tmp_path / "view"), 600, "2026-06-08 10:25:00")
    assert [(r.road_id, r.n) for r in got.collect()] == [("R1", 5)]
    tee = jobs.tee_late(str(tmp_path / "ok"), str(tmp_path / "late"), "update_time", 30)
    tee(spark.createDataFrame([("R1", 1, BASE + dt.timedelta(minutes=5))], schema), 0)
    tee(spark.createDataFrame([("R1", 2, BASE), ("R1", 3, BASE + dt.timedelta(minutes=6))], schema), 1)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [2]


def test_late_mark_outlives_a_restart(spark, tmp_path):
    schema = "road_id string, n int, update_time timestamp"
    make = lambda: jobs.tee_late(str(tmp_path / "ok"), str(tmp_path / "late"), "update_time", 30)
    make()(spark.createDataFrame([("R1", 1, BASE + dt.timedelta(minutes=5))], schema), 0)
    make()(spark.createDataFrame([("R1", 2, BASE)], schema), 1)
    make()(spark.createDataFrame([("R1", 3, BASE), ("R1", 4, BASE + dt.timedelta(minutes=5))], schema), 2)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "late")).collect()) == [2, 3]


def test_alert_text_and_counters(spark):
    m = spark.createDataFrame([("D1", "OFFLINE", BASE, BASE)], "device_id string, rule string, first_ts timestamp, last_ts timestamp")
    assert rules.alert_text(rules.alert_rows(m)).first().value == "ALERT|CRITICAL|OFFLINE|Device D1 continuous offline detected at 1780912800000"
    assert jobs.counters(m, "first_ts").first().n == 1


def heartbeats(seconds, device="D1", flag="OFFLINE"):
    return [(device, BASE + dt.timedelta(seconds=s), flag, 10.0, 20.0) for s in seconds]


def test_rules_to_alerts_to_sink_over_a_restart(spark, tmp_path):
    """Heartbeats to suppressed alert text in one job, stopped after the first part; equal to the batch twin."""
    schema = "device_id string, heartbeat_time timestamp, online_flag string, cpu_usage double, temperature double"
    parts = [heartbeats(range(0, 400, 50)), heartbeats(range(400, 3000, 80)), [("Z", FAR, "ONLINE", 1.0, 1.0)], [("Z", FAR + dt.timedelta(days=1), "ONLINE", 1.0, 1.0)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.start(rules.alerts_of(stream), rules.text_sink(str(tmp_path / "out")), str(tmp_path / "ck"), {"availableNow": True}).awaitTermination(120)
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    batch = rules.alert_rows(rules.matches(spark.createDataFrame(parts[0] + parts[1], schema))).withColumn("kind", F.concat("device_id", "alert_type"))
    want = sorted(r.value for r in rules.alert_text(alerts.suppress(batch, "kind", "last_ts", 30).filter("sent")).collect())
    assert got == want and len(want) >= 2


def test_suppression_stream_equals_batch(spark, tmp_path):
    schema = "k string, ts timestamp, v string"
    rows = [("a", BASE + dt.timedelta(minutes=m), str(m)) for m in (20, 0, 40, 60, 71, 300)]
    s = stream_of(spark, tmp_path / "in", [rows, [("z", FAR, "x")], [("z", FAR + dt.timedelta(hours=1), "x")]], schema)
    got = collected(spark, stateful.suppress_stream(s, ["k"], "ts", 30), "quiet", tmp_path)
    want = alerts.suppress(spark.createDataFrame(rows, schema), "k", "ts", 30).filter("sent")
    assert sorted(r.v for r in got.filter("k = 'a'").collect()) == sorted(r.v for r in want.collect()) and want.count() == 4


def test_suppression_stream_keeps_microseconds(spark, tmp_path):
    schema = "k string, ts timestamp, v string"
    at = lambda m, us: BASE + dt.timedelta(minutes=m, microseconds=us)
    rows = [("a", at(0, 123456), "0"), ("a", at(30, 123455), "1"), ("a", at(30, 123457), "2"), ("b", at(0, 999), "3"), ("b", at(30, 998), "4")]
    s = stream_of(spark, tmp_path / "in", [rows, [("z", FAR, "x")], [("z", FAR + dt.timedelta(hours=1), "x")]], schema)
    got = collected(spark, stateful.suppress_stream(s, ["k"], "ts", 30), "exact", tmp_path).filter("k <> 'z'")
    want = alerts.suppress(spark.createDataFrame(rows, schema), "k", "ts", 30).filter("sent").drop("sent")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and [r.v for r in want.orderBy("v").collect()] == ["0", "2", "3"]


PASSES = "road_id string, device_id string, vehicle_type string, speed int, pass_time timestamp"


@pytest.mark.parametrize("policy, idle, closed", [("min", True, False), ("max", True, True), ("min", False, True), ("max", False, True)])
def test_streams_in_union(spark, tmp_path, policy, idle, closed):
    """An idle source holds windows back under min and does not under max; once it goes on, min closes them as well."""
    rows = [("R1", "D", "S", 10, BASE), ("R2", "D", "S", 10, BASE), ("Z", "D", "S", 1, FAR)]
    one = stream_of(spark, tmp_path / "one", [rows, [("Z", "D", "S", 1, FAR)]], PASSES)
    two = stream_of(spark, tmp_path / "two", [[("R1", "D", "S", 30, BASE)], *([] if idle else [[("Y", "D", "S", 1, FAR)], [("Y", "D", "S", 1, FAR)]])], PASSES)
    try:
        both = jobs.united([(one, "pass_time", "30 seconds"), (two.withColumnRenamed("pass_time", "at"), "at", "2 minutes")], policy)
        got = collected(spark, jobs.road_counts(both, delay=None), f"union_{policy}_{idle}", tmp_path)
        assert {(r.road_id, r.n) for r in got.collect()} == ({("R1", 2), ("R2", 1)} if closed else set())
    finally:
        spark.conf.unset("spark.sql.streaming.multipleWatermarkPolicy")
    plain = spark.createDataFrame(rows, PASSES)
    assert jobs.united([(plain, "pass_time", ""), (plain.withColumnRenamed("pass_time", "at"), "at", "")]).count() == 6
    with pytest.raises(ValueError):
        jobs.united([(plain, "pass_time", "")], "mean")


def until(query, reached, seconds=60):
    """Stops the query once a condition on its progress holds."""
    end = time.time() + seconds
    while time.time() < end and not reached(query.recentProgress):
        time.sleep(0.2)
    done = reached(query.recentProgress)
    query.stop()
    assert done


def test_state_expires_by_processing_time(spark, tmp_path):
    """A key's average goes from the store a while after its last row, without events, and counts no more; a longer life keeps it."""
    schema = "k string, ts timestamp, f double"
    calm = [("r", BASE + dt.timedelta(minutes=i), 10.0) for i in range(6)]
    for ttl, name in ((2000, "short"), (600_000, "long")):
        for k, part in enumerate((calm, [("r", BASE + dt.timedelta(minutes=9), 50.0)])):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / name / "in"))
            out = stateful.flow_spike_arrivals(stream, "k", "ts", "f", ttl_ms=ttl)
            q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / name / "ck")).trigger(processingTime="500 milliseconds").start(str(tmp_path / name / "out"))
            read = lambda p: any(x["numInputRows"] for x in p)
            until(q, (lambda p: read(p) and p[-1]["stateOperators"][0]["numRowsTotal"] == 0) if name == "short" and k == 0 else read)
        hits = spark.read.schema("key string, flow double, history_avg double").parquet(str(tmp_path / name / "out")).collect()
        assert [(r.key, r.flow, r.history_avg) for r in hits] == ([] if name == "short" else [("r", 50.0, 10.0)])


def test_idle_state_is_removed(spark, tmp_path):
    """The state rows of a run fall back once keys have been idle for as long as their rules reach."""
    schema = "k string, ts timestamp, v string"
    many = [(f"k{i}", BASE, "OFFLINE") for i in range(50)]
    s = stream_of(spark, tmp_path / "in", [many, [("z", FAR, "x")], [("z", FAR + dt.timedelta(hours=1), "x")], [("z", FAR + dt.timedelta(hours=2), "x")]], schema)
    out = stateful.sequence_stream(s, "k", "ts", {"off3": (F.col("v") == "OFFLINE", 3, 180)})
    q = out.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    counts = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(counts) >= 100 and counts[-1] <= 8


def test_running_counter(spark, tmp_path):
    schema = "k string, ts timestamp"
    s = stream_of(spark, tmp_path / "in", [[("a", BASE), ("b", BASE)], [("a", BASE), ("c", FAR)]], schema)
    got = collected(spark, jobs.counters(s, "ts"), "running", tmp_path, "complete")
    assert {(r.day, r.n) for r in got.collect()} == {("2026-06-08", 3), ("2026-06-09", 1)}


def test_change_records_as_a_stream(spark, tmp_path):
    """Each batch of change records makes the next snapshot; a repeated batch makes the same one."""
    schema = "type string, ts long, xoffset long, road_id string, speed_limit int"
    day = 1780876800
    sink = jobs.cdc_snapshots(str(tmp_path / "dim"), "road_id", ["speed_limit"], "road_id string, speed_limit int")
    sink(spark.createDataFrame([("insert", day, 1, "A", 50), ("insert", day, 2, "B", 60)], schema), 0)
    for _ in range(2):
        sink(spark.createDataFrame([("update", day + 86400, 3, "A", 70), ("delete", day + 86400, 4, "B", 60)], schema), 1)
    newest = spark.read.parquet(f"{tmp_path}/dim/version={jobs.latest_version(spark, str(tmp_path / 'dim'))}")
    assert sorted((r.road_id, r.is_current, r.speed_limit) for r in newest.collect()) == [("A", "N", 50), ("A", "Y", 70), ("B", "N", 60)]
    text = io.encode_cdc(spark.createDataFrame([("insert", 1, 1, 2, "A", "50")], "type string, ts long, xid long, xoffset long, road_id string, speed_limit string"), "d", "road")
    assert [tuple(r) for r in io.decode_cdc(text, "road", ["road_id", "speed_limit"]).collect()] == [("insert", 1, 2, "A", "50")]


def test_snapshots_do_not_pile_up(spark, tmp_path):
    sink = jobs.upsert_latest(str(tmp_path / "view"), "road_id", "update_time")
    for i in range(4):
        sink(spark.createDataFrame([("R1", i, BASE + dt.timedelta(minutes=i))], "road_id string, n int, update_time timestamp"), i)
    assert sorted(p.name for p in (tmp_path / "view").iterdir()) == ["version=2", "version=3"]


def test_payload(spark):
    one = spark.createDataFrame([(3, 1.5)], "roads int, avg_speed double")
    status = spark.createDataFrame([(99.0,)], "completeness_rate double")
    top = spark.createDataFrame([(2, "R2"), (1, "R1")], "rank int, road_id string")
    got = json.loads(jobs.payload(one, status, {"top_jam_roads": top}).first().payload)
    assert got["city_overview"]["roads"] == 3 and [r["road_id"] for r in got["top_jam_roads"]] == ["R1", "R2"] and got["quality"]["completeness_rate"] == 99.0


def history(spark, path, version):
    return sorted((r.road_id, r.speed_limit, r.start_time, r.end_time, r.is_current) for r in spark.read.parquet(f"{path}/version={version}").collect())


def test_any_split_of_changes_gives_one_history(spark, tmp_path):
    """Several days in one batch, older changes after newer ones, deletes as gaps, one day changed twice, repeated batches."""
    schema = "type string, ts long, xoffset long, road_id string, speed_limit int"
    day = lambda d, s=0: 1780876800 + 86400 * d + s
    rows = [
        ("insert", day(0), 1, "A", 50), ("update", day(1), 2, "A", 60), ("update", day(1, 5), 3, "A", 70), ("update", day(3), 4, "A", 70), ("delete", day(5), 5, "A", 70),
        ("insert", day(8), 6, "A", 70), ("insert", day(2), 7, "B", 30), ("update", day(2), 8, "B", 40), ("delete", day(3), 9, "B", 40), ("insert", day(3, 1), 10, "B", 40), ("delete", day(0), 11, "C", 1),
    ]
    at = lambda d: str((dt.datetime(2026, 6, 8) + dt.timedelta(days=d)).date())
    want = sorted([
        ("A", 50, at(0), at(0), "N"), ("A", 70, at(1), at(4), "N"), ("A", 70, at(8), "9999-12-31", "Y"), ("B", 40, at(2), "9999-12-31", "Y"),
    ])
    splits = [[rows], [rows[:1], rows[1:]], [[r] for r in reversed(rows)], [rows[5:], rows[:5]], [rows[::2], rows[1::2], rows[:3]]]
    for k, batches in enumerate(splits):
        sink = jobs.cdc_snapshots(str(tmp_path / f"dim{k}"), "road_id", ["speed_limit"], "road_id string, speed_limit int", buckets=2)
        for i, batch in enumerate(batches):
            for _ in range(1 + (i == len(batches) - 1)):
                sink(spark.createDataFrame(batch, schema), i)
        assert history(spark, tmp_path / f"dim{k}", len(batches) - 1) == want
    prev = spark.createDataFrame([("A", 50, "1970-01-01", "9999-12-31", "Y", "x"), ("D", 5, "1970-01-01", "2026-06-01", "N", "x")], "road_id string, speed_limit int, start_time string, end_time string, is_current string, dt string")
    once = dims.scd2_from_cdc(prev, spark.createDataFrame(rows, schema), "road_id", ["speed_limit"])
    twice = dims.scd2_from_cdc(dims.scd2_from_cdc(prev, spark.createDataFrame(rows[:2], schema), "road_id", ["speed_limit"]), spark.createDataFrame(rows[2:], schema), "road_id", ["speed_limit"])
    assert sorted(map(tuple, once.drop("dt").collect())) == sorted(map(tuple, twice.drop("dt").collect()))
    assert ("D", 5, "1970-01-01", "2026-06-01", "N") in set(map(tuple, once.drop("dt").collect())) and ("A", 50, "1970-01-01", at(0), "N") in set(map(tuple, once.drop("dt").collect()))


def tree(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet")}


def test_latest_table_writes_only_the_buckets_of_a_batch(spark, tmp_path):
    schema = "road_id string, n int, update_time timestamp"
    path = tmp_path / "view"
    sink = lambda: jobs.upsert_latest(str(path), "road_id", "update_time", buckets=8, most_folders=3)
    sink()(spark.createDataFrame([(f"R{i}", 0, BASE) for i in range(100)], schema), 0)
    kept, want = tree(tmp_path / "view_data"), {f"R{i}": 0 for i in range(100)}
    assert len({f.split("/")[1] for f in kept}) == 8
    for k in range(1, 12):
        batch = [("R1", k, BASE + dt.timedelta(minutes=k)), ("R2", -k, BASE - dt.timedelta(minutes=k))]
        want["R1"] = k
        before = tree(tmp_path / "view_data")
        for _ in range(2):  # repeated, as after a restart
            sink()(spark.createDataFrame(batch, schema), k)
        new = tree(tmp_path / "view_data") - before
        assert len({f.split("/")[1] for f in new}) <= 2
        got = {r.road_id: r.n for r in jobs.read_table(spark, str(path), "road_id", "update_time").collect()}
        assert got == want
    folders = [r.folder for r in spark.read.parquet(str(path / "version=11")).collect()]
    assert len(folders) <= 8 + 2 * 3 and len(list((tmp_path / "view_data").iterdir())) <= 10
    sink()(spark.createDataFrame([], schema), 12)
    assert jobs.read_table(spark, str(path), "road_id", "update_time").count() == 100


def test_recent_list_is_that_of_the_whole_history(spark, tmp_path):
    schema = "k string, ts timestamp, v int"
    rows = [(f"k{i % 7}", BASE + dt.timedelta(minutes=i * 37 % 50), i % 3) for i in range(120)]
    sink = jobs.keep_recent(str(tmp_path / "list"), 20)
    for i in range(4):
        for _ in range(1 + i % 2):
            sink(spark.createDataFrame(rows[i::4], schema), i)
        want = jobs.recent(spark.createDataFrame([r for k in range(i + 1) for r in rows[k::4]], schema), 20)
        assert jobs.read_recent(spark, str(tmp_path / "list")).collect() == want.collect()


def test_late_rows_are_repaired_once(spark, tmp_path):
    """Only touched days are written, a second run and a run that lost its ledger double nothing."""
    schema = "vehicle_id string, road_id string, vehicle_type string, speed int, pass_time timestamp, hour int, dt string"
    row = lambda v, d, h, speed=10: (v, "R1", "SMALL", speed, dt.datetime(2026, 6, d, h), h, f"2026-06-{d:02d}")
    detail, hours, late = str(tmp_path / "detail"), str(tmp_path / "hours"), str(tmp_path / "late")
    first = spark.createDataFrame([row("a", 1, 1), row("b", 2, 1), row("c", 3, 1)], schema)
    io.write_dt(first, detail)
    io.write_dt(jobs.dws_road_hour_flow(first), hours)
    untouched = sorted(str(p) for p in (tmp_path / "hours" / "dt=2026-06-03").iterdir())
    spark.createDataFrame([row("d", 1, 1, 30), row("a", 1, 1)], schema).write.parquet(f"{late}/batch=4")
    spark.createDataFrame([row("e", 2, 5)], schema).write.parquet(f"{late}/batch=7")
    flow = lambda: sorted((r.dt.isoformat(), r.hour, r.traffic_count, r.total_speed) for r in spark.read.orc(hours).collect())
    want = [("2026-06-01", 1, 2, 40), ("2026-06-02", 1, 1, 10), ("2026-06-02", 5, 1, 10), ("2026-06-03", 1, 1, 10)]
    assert jobs.repair_late(spark, late, detail, hours) == [4, 7] and flow() == want
    assert jobs.repair_late(spark, late, detail, hours) == [] and flow() == want
    shutil.rmtree(f"{late}_taken")
    assert jobs.repair_late(spark, late, detail, hours) == [4, 7] and flow() == want
    spark.createDataFrame([row("f", 2, 5)], schema).write.parquet(f"{late}/batch=8")
    assert jobs.repair_late(spark, late, detail, hours) == [8] and ("2026-06-02", 5, 2, 20) in flow()
    assert sorted(str(p) for p in (tmp_path / "hours" / "dt=2026-06-03").iterdir()) == untouched


@pytest.mark.parametrize("n", [1, 3])
def test_serving_reads(spark, n):
    df = spark.createDataFrame([(f"R{i}", i, BASE + dt.timedelta(minutes=i), 10.0) for i in range(5)], "road_id string, n int, ts timestamp, avg_speed double")
    assert jobs.ranked(df, "n", n).count() == n and jobs.recent(df, n).first().n == 4 and jobs.by_count(df, n).first().n == 4
    assert jobs.one(df, "road_id", "R2").count() == 1
