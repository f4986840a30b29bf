"""Numbers on a half, rounded as the SQL rounds them."""

import datetime as dt

import duckdb
from compare import differences

from __spark_entry__ import oracle_sql, queries
from pulseframe.functions.scalars import to_places


def test_to_places_rounds_the_binary_multiple(spark):
    values = [0.145, 0.565, 3.095, 1.005, 0.125, 0.375, 2.675, 0.0, -0.125, -0.145, 0.004, 7.25, 49.99, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.t for r in df.select(to_places("x", 2).alias("t")).collect()]
    assert got == [duckdb.execute("select round(?::double, 2)", [v]).fetchone()[0] for v in values]
    assert got[:2] == [0.14, 0.56]  # decimal rounding gives 0.15 and 0.57


def test_sleep_hours_on_a_half_agree_with_the_sql(spark, tmp_path):
    """User 1 slept 522 seconds, 0.145 hours; the message says how long."""
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    day = dt.datetime(2024, 1, 26, 8)
    rows = [(1, day, 1, "signup", 8.7, '{"k": 1}'), (2, day, 1, "view", 80.0, '{"k": 1}')]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    for name in ("orders", "lineitem", "events"):
        files = f"{tmp_path}/{name}.parquet" + ("/*.parquet" if name == "events" else "")
        con.execute(f"create view {name} as select * from '{files}'")
    df = queries()["export_to_recommendation"](spark, str(tmp_path))
    assert "(0.14 hours)" in df.first()["safety_message"]
    assert differences(df, con, oracle_sql()["export_to_recommendation"]) is None
