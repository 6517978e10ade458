"""Every registered query of the library against its SQL in DuckDB."""

import duckdb
import pytest

from roadlake.plans import all_queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(value(v) for v in r) for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(all_queries.SQL))
def test_same_rows(spark, sf_dir, duck, name):
    got = all_queries.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(all_queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_dimension_join_is_broadcast(spark, sf_dir):
    df = all_queries.QUERIES["q29_passes_per_road"](spark, sf_dir)
    assert "BroadcastHashJoin" in df._jdf.queryExecution().toString()


def test_suppression_of_tied_alarms_as_in_sql(spark, sf_dir, tmp_path):
    """Alarms of one device at one time, and some without a time."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"""copy (select * exclude (i) replace (event_id + 1000000 * i as event_id, case when event_id % 50 <> 1 or i < 2 then ts end as ts)
        from '{sf_dir}/events.parquet', range(3) t(i)) to '{tmp_path}/events.parquet'""")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = all_queries.QUERIES["l1_suppress"](spark, str(tmp_path)).toPandas()
    want = con.execute(all_queries.SQL["l1_suppress"]).df()
    ids = [pdf[pdf.alarm_time.notna()] for pdf in (got, want)]  # an id holds the time
    assert rows(ids[0]) == rows(ids[1]) and rows(got.drop(columns="alarm_id")) == rows(want.drop(columns="alarm_id"))
    sent = want[want.sent.fillna(False).astype(bool)]
    assert sent.duplicated(["device_id", "alarm_time"]).any() and want.sent.isna().any()
