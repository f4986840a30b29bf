"""Windows over hand-written days."""

import datetime as dt

from pyspark.sql import functions as F

from pulseframe.operators import daily as dy
from pulseframe.operators import features as ft

START = dt.date(2024, 1, 1)


def days(spark, name, values, user=1, dates=None):
    dates = dates or [START + dt.timedelta(days=i) for i in range(len(values))]
    rows = [(user, d, None if v is None else float(v)) for d, v in zip(dates, values, strict=True)]
    return spark.createDataFrame(rows, f"user_id bigint, date date, {name} double")


def series(df, column):
    return [r[0] for r in df.orderBy("date").select(column).collect()]


def test_slope_of_three_rows(spark):
    df = days(spark, "hrv", [None, 2, 5, 11, None, 3])
    assert series(df.select("date", ft.slope_of_last_three("hrv").alias("s")), "s") == [None, None, None, 4.5, None, None]
    two = days(spark, "hrv", [2, 5])
    assert series(two.select("date", ft.slope_of_last_three("hrv").alias("s")), "s") == [0.0, 3.0]


def test_slope_needs_the_middle_value(spark):
    df = days(spark, "hrv", [1, None, 3])
    assert series(df.select("date", ft.slope_of_last_three("hrv").alias("s")), "s")[2] is None


def test_sleep_debt_stays_null_without_values(spark):
    df = days(spark, "sleep_duration_hours", [1, None, 3, None, None, None])
    assert series(df.select("date", ft.sleep_debt().alias("s")), "s") == [7, 7, 6, 5, 5, None]


def test_sleep_debt_is_not_negative(spark):
    assert series(days(spark, "sleep_duration_hours", [10]).select("date", ft.sleep_debt().alias("s")), "s") == [0.0]


def test_streak_and_rows_since(spark):
    df = ft.numbered(days(spark, "completion", [None, 0, 1, 1, None, 1, 0, 1]))
    done = ft.completed()
    out = df.select("date", ft.streak(done).alias("streak"), ft.rows_since(done).alias("since"))
    assert series(out, "streak") == [0, 0, 1, 2, 0, 1, 0, 1]
    assert series(out, "since") == [0, 1, 0, 0, 1, 0, 1, 0]


def test_zscore_is_null_on_the_first_value(spark):
    df = days(spark, "hrv", [40, 50])
    first, second = series(df.select("date", ft.zscore("hrv").alias("z")), "z")
    assert first is None
    assert abs(second - 5 / (50**0.5 + 1e-6)) < 1e-9


def test_frames_count_rows_not_days(spark):
    far = [START, START + dt.timedelta(days=100), START + dt.timedelta(days=200)]
    df = days(spark, "hrv", [10, 20, 30], dates=far)
    assert series(df.select("date", ft.mean_of_last("hrv", 7).alias("m")), "m") == [10, 15, 20]


def test_high_load_runs_end_at_missing_days(spark):
    dates = [START + dt.timedelta(days=d) for d in (0, 1, 2, 4, 5, 6, 7)]
    df = days(spark, "active_calories", [500, 500, 500, 500, 500, None, 500], dates=dates)
    runs = ft.high_load_runs(df).collect()
    assert [(r.start_date, r.end_date, r.days) for r in runs] == [(dates[0], dates[2], 3)]
    assert series(ft.with_high_load_days(df), "consecutive_high_days") == [1, 2, 3, 1, 2, 0, 1]


def test_last_week_uses_calendar_days(spark):
    dates = [START, START + dt.timedelta(days=6), START + dt.timedelta(days=7)]
    df = days(spark, "completion", [1, 1, 0], dates=dates).withColumn("rpe", F.lit(5))
    assert series(ft.last_week_training(df), "training_frequency_last_week") == [1, 2, 1]


def test_absent_inputs_give_null_columns(spark):
    out = ft.daily_features(days(spark, "hrv", [40, 41]))
    assert out.columns[:3] == ["user_id", "date", "completion"]
    assert set(ft.FEATURES) <= set(out.columns)
    row = out.orderBy("date").first()
    assert row.steps_7d_sum is None and row.steps_missing == 1 and row.hrv_missing == 0 and row.streak == 0


def test_users_do_not_mix(spark):
    both = days(spark, "hrv", [10, 20], user=1).union(days(spark, "hrv", [100, 200], user=2))
    out = ft.daily_features(both).where("user_id = 2").orderBy("date")
    assert [r.hrv_7d_mean for r in out.collect()] == [100, 150]


def test_unreadable_activity_sums_to_zero_and_absent_to_null(spark):
    records = spark.createDataFrame(
        [(1, START, "steps", None, None), (1, START, "heart_rate", 60.0, None), (1, START, "resting_heart_rate", 50.0, None)],
        "user_id bigint, date date, type string, value double, duration double",
    )
    row = dy.daily_measures(records).first()
    assert (row.steps, row.active_calories, row.resting_hr, row.hr_max) == (0.0, None, 50.0, 60.0)


def test_single_aggregation_equals_the_joined_tables(spark, folder):
    from pulseframe.plans.inputs import source

    records = source(spark, folder, "records").withColumn("duration", F.col("value"))
    joined = (
        dy.daily_heart_rate(records)
        .join(dy.daily_activity(records), dy.KEYS, "full")
        .join(dy.daily_sleep(records), dy.KEYS, "full")
    )
    whole = dy.daily_measures(records).drop("hrv").select(*joined.columns)
    seen = dy.KEYS
    left = joined.orderBy(*seen).collect()
    right = whole.join(joined.select(*seen), seen, "left_semi").orderBy(*seen).collect()
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or abs(x - y) < 1e-9


def test_unify_prefers_the_first_source(spark):
    a = days(spark, "hrv", [1, None])
    b = days(spark, "hrv", [5, 6, 7])
    out = dy.unify({"oura": a, "apple": b}).orderBy("date").collect()
    assert [(r.hrv_oura, r.hrv_apple, r.hrv) for r in out] == [(1, 5, 1), (None, 6, 6), (None, 7, 7)]
