import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roadlake.functions.columns import to_time
from roadlake.operators import joins, quality
from roadlake.plans.run import replay, run_day
from roadlake.sources import io, maintain, schemas, versions
from roadlake.sources.roles import role
from roadlake.streaming import backlog, jobs


def test_text_and_json_decoding(spark):
    lines = spark.createDataFrame([("R1\t50\t100\t2\t10.5\tNORMAL\t2026-06-08 10:00:00",), ("R2\t\t",)], "value string")
    rows = io.decode_text(lines, schemas.TRAFFIC_STATUS).collect()
    assert rows[0].avg_speed == "50" and rows[1].avg_speed is None
    js = spark.createDataFrame([('{"a": 1}',), ("not json",)], "value string")
    good = io.within_budget(io.decode_json(js, "a int"), 1, 60.0)
    assert good.count() == 1
    with pytest.raises(io.BadRecords):
        io.within_budget(io.decode_json(js, "a int"), 0, 2.0)


def test_cdc_and_times(spark):
    line = '{"database":"d","table":"road","type":"delete","ts":5,"xid":1,"xoffset":2,"data":{"road_id":"R1"}}'
    df = spark.createDataFrame([(line,)], "value string")
    assert io.decode_cdc(df, "road", ["road_id"]).first().road_id == "R1"
    assert io.decode_cdc(df, "road", ["road_id"], keep_deletes=False).count() == 0
    t = spark.createDataFrame([("1780000000000",), ("2026-06-08 10:00:00",), ("x",)], "t string").select(to_time(F.col("t")).alias("t")).collect()
    assert t[1].t == dt.datetime(2026, 6, 8, 10) and t[0].t is not None and t[2].t is None


def test_landing_and_partition_overwrite(spark, tmp_path):
    day = tmp_path / "ods" / "dt=2026-06-08"
    day.mkdir(parents=True)
    (day / "a.txt").write_text("R1\t50\t\t2\t1\tNORMAL\t2026-06-08 10:00:00\n")
    row = io.read_landing(spark, str(tmp_path / "ods"), schemas.TRAFFIC_STATUS, "2026-06-08").first()
    assert row.road_id == "R1" and row.traffic_flow is None
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, dt string")
    io.write_dt(df, out, bloom=["v"])
    io.write_dt(spark.createDataFrame([(3, "b")], "v int, dt string"), out)
    assert {(r.v, r.dt) for r in spark.read.orc(out).collect()} == {(1, "a"), (3, "b")}
    pruned = spark.read.orc(out).filter("dt = 'a'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in pruned


def test_json_array_and_extract(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"road_id": 1, "dt": "x"}, {"road_id": 2, "dt": "y"}]')
    assert io.read_json(spark, str(tmp_path / "a.json"), "road_id int, dt string", array=True).count() == 2
    src = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-02"), (3, "2026-01-03")], "id int, updated_at string")
    assert [r.id for r in io.extract(src, ["id"], "2026-01-02", "2026-01-03").collect()] == [2]


def test_logs_hide_secrets(spark):
    df = spark.createDataFrame([('{"timestamp":"2026-06-08T10:00:00","job":"etl-a","level":"info","message":"token=abc ok"}',), ("2026-06-08 10:00:00 ERROR stream-x: it failed",)], "value string")
    rows = io.structure_logs(df).orderBy("component").collect()
    assert rows[0].message == "token=*** ok" and rows[0].component == "etl" and rows[1].level == "ERROR" and rows[1].day == "2026-06-08"


def test_maintenance(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.range(100).withColumn("dt", F.when(F.col("id") < 50, "2026-01-01").otherwise("2026-06-01")).withColumn("ts", F.timestamp_seconds(F.col("id") * 3600))
    df.repartition(8).write.partitionBy("dt").parquet(root)
    before = {r.dt: r.file_count for r in maintain.file_profile(spark, root).collect()}
    assert before["2026-06-01"] > 1
    assert maintain.compact(spark, f"{root}/dt=2026-06-01", 256) == 1
    after = {r.dt: r.file_count for r in maintain.file_profile(spark, root).collect()}
    assert after["2026-06-01"] == 1 and spark.read.parquet(root).count() == 100
    maintain.compact_by(spark, f"{root}/dt=2026-01-01", "day", "ts")
    assert spark.read.parquet(f"{root}/dt=2026-01-01").count() == 50
    assert maintain.drop_expired(spark, root, "2026-06-08") == ["2026-01-01"]
    assert maintain.partitions(spark, root) == ["2026-06-01"]
    assert maintain.compact_recent(spark, [root], 1)


def test_backfill_limits():
    done = []
    io.backfill(lambda a, b: done.append((a, b)), "2026-06-01", "2026-06-03", "2026-06-08")
    assert done == [("2026-06-01", "2026-06-03")]
    with pytest.raises(ValueError):
        io.backfill(lambda a, b: None, "2026-01-01", "2026-06-03", "2026-06-08")


GOOD = {
    "traffic_vehicle": ["V1\tR1\tD1\t2026-06-08 07:10:00\t50\tN\tP1\tSMALL\t1", "V2\tR1\tD1\t2026-06-08 07:20:00\t70\t\tP2\tLARGE\t2"],
    "traffic_status": ["R1\t40\t100\t3\t45.5\tNORMAL\t2026-06-08 07:00:00", "R1\t10\t100\t5\t80\tPEAK_HOUR\t2026-06-08 08:00:00"],
    "device_status": ["D1\t50.5\t60\t30.5\tONLINE\t2026-06-08 07:00:00\t-50\tCAMERA", "D1\t95\t60\t30.5\tOFFLINE\t1780904000000\t-50\tRADAR"],
    "device_alarm": ["L1\tD1\tOFFLINE\tMAJOR\tx\t2026-06-08 07:00:00\t2026-06-08 07:30:00\tRECOVERED"],
}
BAD = {
    "traffic_vehicle": ["V3\tR1\tD1\tsoon\tfast\tN\tP1\tSMALL\tx"], "traffic_status": ["R1\tx\ty\tz\tmuch\tNORMAL\tnever"],
    "device_status": ["D1\tn/a\t60\t30\tONLINE\t?\t-50\tCAMERA"], "device_alarm": ["\tD1\tOFFLINE\tMAJOR\tx\tnever\t\tRECOVERED"],
}
LANDING = {"traffic_vehicle": "vehicle_pass", "traffic_status": "traffic_status", "device_status": "device_status", "device_alarm": "alarm_log"}


def landed(spark, base, lines):
    out = {}
    for feed, table in LANDING.items():
        day = base / table / "dt=2026-06-08"
        day.mkdir(parents=True)
        (day / "a.txt").write_text("\n".join(lines[feed]) + "\n")
        out[table] = io.within_budget(io.read_landing(spark, str(base / table), schemas.FEEDS[feed], "2026-06-08"), 0, 50.0)
    out["road"] = spark.createDataFrame([("R1", "Main", "BRANCH", 4, 60, "A1")], "road_id string, road_name string, road_type string, lane_count int, speed_limit int, area_id string")
    out["area"] = spark.createDataFrame([("A1", "North", "C1", "City")], "area_id string, area_name string, city_id string, city_name string")
    out["device"] = spark.createDataFrame([("D1", "Cam", "CAMERA", "M", "R1")], "device_id string, device_name string, device_type string, manufacturer string, road_id string")
    return out


def test_landing_text_to_tables(spark, tmp_path):
    """Good text of all four feeds reaches the last layer; bad fields drop their row and raise nothing."""
    root, lines = str(tmp_path / "tables"), {k: v + BAD[k] for k, v in GOOD.items()}
    report = replay(spark, landed(spark, tmp_path / "ods", lines), root, "2026-06-08", "2026-06-08", "2026-06-10")
    assert report.count() == 1
    want = {"dwd_vehicle_pass": 2, "dwd_traffic_status": 2, "dwd_device_status": 2, "dwd_alarm_log": 1, "ads_device_health_score": 1, "ads_traffic_operation": 1}
    assert {t: spark.read.parquet(f"{root}/{t}").count() for t in want} == want
    status = spark.read.parquet(f"{root}/dwd_device_status")
    assert dict(status.dtypes)["cpu_usage"] == "decimal(5,2)" and status.filter("health_flag = 'ABNORMAL'").count() == 1
    assert status.filter("heartbeat_time is null").count() == 0
    with pytest.raises(ValueError):
        replay(spark, {}, "", "2026-01-01", "2026-01-02", "2026-06-08")


def test_lines_that_do_not_fit_count_against_the_budget(spark, tmp_path):
    with pytest.raises(io.BadRecords):
        landed(spark, tmp_path, {**GOOD, "traffic_status": ["R1\t40"] * 3})


def test_a_large_day_is_several_files(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(0, 200_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("v"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("dt"))
        io.write_dt(rows, str(tmp_path / "t"), "parquet")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    n = {r.dt: r.file_count for r in maintain.file_profile(spark, str(tmp_path / "t")).collect()}
    assert n["a"] == 1 and n["b"] > 3 and spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_file_tail_and_catalog(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(GOOD["traffic_status"]))
    stream = io.read_feed(spark, "traffic_status", "text", {"path": str(tmp_path / "in")})
    decoded = io.decode_text(stream, schemas.TRAFFIC_STATUS)
    q = decoded.writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.road_id for r in spark.table("tail").collect()} == {"R1"} and "collect_time" in spark.table("tail").columns
    io.full_extract(spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), ["id"], str(tmp_path / "dim"), "2026-06-08", "parquet")
    spark.sql("drop table if exists dim_copy")
    io.register(spark, "dim_copy", str(tmp_path / "dim"), "parquet")
    assert spark.table("dim_copy").count() == 2
    spark.sql("drop table dim_copy")
    io.write_json(spark.table("tail").limit(1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_relational_source(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).selectExpr("cast(id as int) as ID", "cast(id % 7 as int) as V").write.jdbc(url, "t", properties={"driver": driver})
    whole = io.read_jdbc(spark, url, "t", "ID", 0, 100, 4, driver=driver)
    assert whole.rdd.getNumPartitions() == 4 and whole.count() == 100
    plan = io.extract(whole, ["ID"], 10, 20, at="ID")
    assert plan.count() == 10 and "*GreaterThanOrEqual(ID,10), *LessThan(ID,20)]" in plan._jdf.queryExecution().toString()


def test_one_file_a_bucket(spark, tmp_path):
    rows = spark.range(480).select("id", F.timestamp_seconds(F.col("id") * 360 + 1717200000).alias("ts"))
    rows.repartition(6).write.parquet(str(tmp_path / "t"))
    maintain.compact_by(spark, str(tmp_path / "t"), "3h", "ts")
    per = spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name().alias("f")).agg(F.countDistinct(F.floor(F.unix_timestamp("ts") / 10800)).alias("n"))
    assert {r.n for r in per.collect()} == {1} and per.count() == 16


def test_run_day_equals_whole_build(spark, sf_dir, tmp_path):
    from roadlake.plans.warehouse import Warehouse

    names = ("vehicle_pass", "traffic_status", "device_status", "alarm_log", "road", "device", "area")
    landing = {n: role(spark, sf_dir, n) for n in names}
    report = run_day(spark, landing, str(tmp_path / "w"), "2024-01-05")
    assert report.count() == 1
    whole = Warehouse(lambda n: role(spark, sf_dir, n))
    for name in ("dws_road_hour_flow", "ads_device_fault_top"):
        got = spark.read.parquet(f"{tmp_path}/w/{name}")
        want = whole[name].filter("dt = '2024-01-05'")
        assert got.count() == want.count() > 0


def test_a_reader_sees_one_whole_version(spark, tmp_path):
    """During a rewrite, after a writer that stopped before or within its commit, and after a conflict."""
    path = str(tmp_path / "table")
    assert versions.current(spark, path) is None
    versions.publish(spark, spark.range(100), path)
    reader = versions.read_current(spark, path)
    spark.range(7).write.parquet(f"{path}/v=unfinished")  # stopped before the commit
    assert versions.read_current(spark, path).count() == 100
    first = versions._last(spark, path)
    versions.compact_current(spark, path, 1)
    assert reader.count() == 100 and versions.read_current(spark, path).count() == 100
    assert len(list(Path(versions.current(spark, path)).glob("*.parquet"))) == 1
    with pytest.raises(versions.Conflict):
        versions.publish(spark, spark.range(5), path, after=first)
    assert versions.read_current(spark, path).count() == 100
    (Path(path) / "_log" / f"{versions._last(spark, path) + 1:012d}").write_text("v=unfin")  # stopped within the commit
    assert versions.read_current(spark, path).count() == 100
    for n in (3, 4, 5):
        versions.publish(spark, spark.range(n).withColumn("dt", F.lit("a")), path, by=["dt"])
        assert versions.read_current(spark, path).count() == n
    assert len([p for p in Path(path).iterdir() if p.name.startswith("v=")]) == versions.KEEP + 1  # and the unfinished one
    with pytest.raises(ValueError):
        versions.read_current(spark, str(tmp_path / "none"))


def test_one_far_time_makes_one_file(spark, tmp_path):
    t = dt.datetime(2026, 6, 8)
    rows = [(i, t + dt.timedelta(hours=i)) for i in range(48)] + [(100, dt.datetime(1970, 1, 1)), (101, None)]
    spark.createDataFrame(rows, "i int, ts timestamp").write.parquet(str(tmp_path / "p"))
    maintain.compact_by(spark, str(tmp_path / "p"), "day", "ts")
    sizes = sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "p")).groupBy(F.input_file_name()).count().collect())
    assert sizes == [2, 24, 24]


def test_hot_keys_are_found(spark):
    """Every key of over the share, among many of one row each, in many partitions; the join equals the plain one."""
    n = 60_000
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 50 == 1, F.lit(-2)).otherwise(F.col("id"))
    df = spark.range(0, n, 1, 16).select(key.alias("k"), (F.col("id") % 11).alias("v")).withColumn("k", F.when(F.col("v") == 10, None).otherwise(F.col("k")))
    hot = joins.found_hot_keys(df, "k", 0.01)
    assert {-1, -2} <= set(hot) and len(hot) <= 200
    assert not joins.found_hot_keys(df.limit(0), "k")
    right = spark.range(-2, 3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        got, want = joins.balanced_join(df, right, "k", how=how), df.join(right, "k", how)
        total = lambda x: x.agg(F.count("*"), F.sum("v"), F.sum("w"), F.sum(F.hash("k", "v", "w").cast("long"))).first()
        assert total(got.select("k", "v", "w")) == total(want.select("k", "v", "w"))
    with pytest.raises(ValueError):
        joins.found_hot_keys(df, "k", 1e-5)


def test_backlog_of_streams(spark, tmp_path):
    """A file stream before its first batch, with unread input, and when it has read all; offsets by topic and partition."""
    source, out, ck = (str(tmp_path / n) for n in ("in put", "out", "ck"))
    lag = lambda: tuple(backlog.file_backlog(spark, ck, source, "d").first())[2:]
    run = lambda: jobs.run_available(spark.readStream.schema("id long").parquet(source), out, ck)
    spark.range(0, 30, 1, 3).write.parquet(source)
    assert lag() == (30, 0)
    run()
    assert lag() == (30, 30)
    spark.range(12).write.mode("append").parquet(source)
    assert lag() == (42, 30)
    run()
    assert lag() == (42, 42)
    progress = {"timestamp": "2026-06-08T10:00:00Z", "sources": [
        {"endOffset": {"t": {"0": 5, "1": 7}}, "latestOffset": {"t": {"0": 9, "1": 7, "2": 4}}}, {"endOffset": '{"u": {"0": 1}}', "latestOffset": '{"u": {"0": 3}}'}, {"endOffset": {"logOffset": 3}, "latestOffset": None}]}
    rows = backlog.progress_offsets(progress)
    assert rows == [("2026-06-08", "t-0", 9, 5), ("2026-06-08", "t-1", 7, 7), ("2026-06-08", "t-2", 4, 0), ("2026-06-08", "u-0", 3, 1)]
    assert quality.backlog(spark.createDataFrame(rows, backlog.OFFSETS)).first().value == 10
