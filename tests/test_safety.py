"""Safety checks, limits and plans over hand-written states."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import policy as po
from pulseframe.operators import safety as sf
from pulseframe.operators.catalog import ACTIONS, catalogue, resolve, within_limits

STATE = (
    "user_id bigint, date date, resting_hr double, hrv double, sleep_duration_hours double, readiness_score double, "
    "fatigue int, soreness int, overtraining_risk boolean"
)
GOOD = dict(
    resting_hr=60.0,
    hrv=50.0,
    sleep_duration_hours=8.0,
    readiness_score=80.0,
    fatigue=3,
    soreness=2,
    overtraining_risk=False,
)


def state(spark, **change):
    values = {**GOOD, **change}
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), *values.values())], STATE)
    return df.withColumn("consecutive_high_days", F.lit(0))


def outcome(spark, **change):
    return sf.assess(state(spark, **change)).first()


@pytest.mark.parametrize(
    ("change", "risk", "action"),
    [
        ({}, "low", "proceed_with_plan"),
        ({"resting_hr": 101.0}, "high", "rest_day_or_light_activity"),
        ({"hrv": 19.5}, "high", "rest_day_or_light_activity"),
        ({"overtraining_risk": True, "hrv": 10.0}, "critical", "mandatory_rest_day"),
        ({"fatigue": 8}, "high", "rest_day_or_recovery_session"),
        ({"sleep_duration_hours": 3.5}, "medium", "light_training_or_rest"),
        ({"readiness_score": 49.0}, "medium", "reduce_intensity"),
        ({"soreness": 8}, "high", "active_recovery_or_rest"),
        ({"fatigue": 9, "soreness": 9}, "high", "rest_day_or_recovery_session"),
        ({"readiness_score": 10.0, "soreness": 9}, "high", "active_recovery_or_rest"),
        ({"hrv": 0.0, "readiness_score": 0.0, "sleep_duration_hours": 0.0}, "low", "proceed_with_plan"),
        ({"hrv": None, "readiness_score": None, "fatigue": None}, "low", "proceed_with_plan"),
    ],
)
def test_most_severe_check_wins(spark, change, risk, action):
    row = outcome(spark, **change)
    assert (row.risk_level, row.recommended_action, row.is_safe) == (risk, action, risk == "low")


def test_both_signals_are_named(spark):
    row = outcome(spark, resting_hr=110.0, hrv=12.5)
    assert row.message == (
        "Abnormal physiological signals detected: Resting heart rate elevated (110.0 bpm); HRV very low (12.5 ms)"
    )


def test_training_frequency_counts_when_given(spark):
    df = state(spark).withColumn("training_frequency_last_week", F.lit(4))
    row = sf.assess(df).first()
    assert (row.recommended_action, row.message) == (
        "reduce_intensity_or_rest",
        "High training frequency detected (4 days/week)",
    )


def test_limits_of_the_profiles(spark):
    low, high = [0, 1, 2], list(range(18))
    medium = [a[0] for a in ACTIONS if a[5] <= 2]
    get = lambda profile, **change: sf.with_allowed(state(spark, **change), profile).first().allowed
    assert get("coded") == high
    assert get("coded", fatigue=9) == high
    assert get("coded", readiness_score=40.0) == medium
    assert get("coded", hrv=10.0) == low
    assert get("declared", fatigue=9) == low
    assert get("declared", readiness_score=40.0, hrv=10.0) == low
    assert get("declared", overtraining_risk=True) == [0]
    assert get("minimal", readiness_score=0.0) == low
    assert get("minimal", fatigue=7) == [0, 1, 2, 3, 4, 9, 10, 11]
    run = sf.allowed_declared(state(spark).withColumn("consecutive_high_days", F.lit(3)))
    assert run.first().allowed == medium


def test_catalogue(spark):
    rows = catalogue(spark).orderBy("action_id").collect()
    assert len(rows) == 18
    assert (rows[8].workout_type, rows[8].intensity, rows[8].duration_minutes) == ("STRENGTH", "HIGH", 45)
    assert (rows[13].workout_type, rows[13].intensity, rows[13].duration_minutes) == ("CARDIO", "MEDIUM", 30)


def test_resolve_defaults_to_rest(spark):
    df = spark.createDataFrame(
        [("CARDIO", "LOW", 45), ("YOGA", "LOW", 45)], "workout_type string, intensity string, duration_minutes int"
    )
    assert {r.workout_type: r.action_id for r in resolve(df).collect()} == {"CARDIO": 11, "YOGA": 0}


def test_limits_per_row(spark):
    df = spark.createDataFrame([(["CARDIO"], "LOW"), (["REST"], "WILD")], "t array<string>, m string")
    ids = df.select(within_limits(F.col("t"), F.col("m")).alias("ids")).collect()
    assert [r.ids for r in ids] == [[9, 10, 11], [0]]


PLAN = "session_id int, position int, exercise_name string, intensity string, fatigue int, injuries array<string>"


def test_plan_checks(spark):
    rows = [
        (1, 1, "Bench press", "high", 7, ["press"]),
        (2, 2, "Deep KNEE bend", "low", 9, ["knee", "hip"]),
        (2, 1, "Hip thrust", "low", 9, ["knee", "hip"]),
        (3, 1, "Row", "high", 6, None),
        (4, 1, "Row", "moderate", 9, []),
    ]
    long = spark.createDataFrame(rows, PLAN)
    got = {r.session_id: r for r in sf.plan_safety(long, ["session_id"]).collect()}
    assert [got[i].recommended_action for i in (1, 2, 3, 4)] == ["reduce_intensity", "modify_plan", "proceed", "proceed"]
    assert got[2].message.endswith(": hip thrust") and got[2].risk_level == "critical"
    nested = long.groupBy("session_id", "intensity", "fatigue", "injuries").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", F.col("exercise_name").alias("name")))), lambda e: e
        ).alias("exercises")
    )
    same = {r.session_id: r.message for r in sf.plan_safety_nested(nested).collect()}
    assert same == {i: r.message for i, r in got.items()}


def test_plan_adjustment(spark):
    rows = [
        ("rest_day_or_light_activity", "high"),
        ("reduce_intensity", "high"),
        ("reduce_intensity", "moderate"),
        ("reduce_intensity", "low"),
        ("proceed", "high"),
    ]
    df = spark.createDataFrame(rows, "recommended_action string, intensity string").withColumn("volume", F.lit("high"))
    got = [(r.intensity, r.volume) for r in sf.adjust_plan(df).collect()]
    assert got == [("low", "low"), ("moderate", "high"), ("low", "high"), ("low", "high"), ("high", "high")]


def test_summary_skips_missing_metrics(spark):
    df = state(spark, readiness_score=0.0, resting_hr=None, fatigue=4).withColumn("days_since_training", F.lit(0))
    text = df.select(sf.state_summary(df.columns).alias("t")).first().t
    assert text == "Last trained 0 days ago. Fatigue level: 4/10"
    bare = df.select("readiness_score")
    assert bare.select(sf.state_summary(bare.columns).alias("t")).first().t == "No data available"


def test_rule_policy(spark):
    opened = state(spark).withColumns({"allowed": F.array(*[F.lit(i) for i in range(18)]), "days_since_training": F.lit(1)})
    pick = lambda **c: po.rule_policy(opened.withColumns({k: F.lit(v) for k, v in c.items()})).first().action_id
    assert pick(readiness_score=39.0) == 0
    assert pick(sleep_duration_hours=4.9) == 0
    assert pick(fatigue=7) == 1
    assert pick(days_since_training=3) == 5
    assert pick() == 1
    narrow = opened.withColumn("allowed", F.array(F.lit(7), F.lit(8)))
    assert po.rule_policy(narrow).first().action_id == 7
    none = opened.withColumn("allowed", F.array().cast("array<int>"))
    assert po.rule_policy(none).first().action_id == 0
