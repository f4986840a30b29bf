"""Episode evaluation against plain Python, with ranges small enough to cross."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from pulseframe.operators import bounded as bd
from pulseframe.operators import evaluate as ev
from pulseframe.operators import history as hi
from pulseframe.operators import quality as ql


def episodes(spark, sizes):
    rng = np.random.default_rng(5)
    rows = [
        (p, e, int(rng.integers(0, 18)), int(rng.integers(0, 18)), float(rng.random()), bool(rng.random() < 0.1))
        for p, n in sizes.items()
        for e in range(n)
    ]
    return (
        spark.createDataFrame(
            rows,
            "policy string, episode bigint, action_id int, optimal_action_id int, reward double, is_overtraining boolean",
        ),
        rows,
    )


def rolling(values, window=50):
    return [float(np.mean(values[max(0, i - window + 1) : i + 1])) for i in range(len(values))]


def test_rolling_reward_across_ranges(spark):
    df, rows = episodes(spark, {"a": 403, "b": 77})
    got = {(r.policy, r.episode): r.rolling_reward for r in ev.rolling_reward(df, 50, 64).collect()}
    assert len(got) == len(rows)
    for p in "ab":
        for i, v in enumerate(rolling([r[4] for r in rows if r[0] == p])):
            assert abs(got[p, i] - v) < 1e-9


def test_convergence(spark):
    df, rows = episodes(spark, {"a": 403, "b": 30})
    got = {r.policy: r.convergence_episode for r in ev.convergence_episode(df).collect()}
    rolled = rolling([r[4] for r in rows if r[0] == "a"])
    target = np.percentile(rolled[-100:], 25)
    assert got == {"a": next(i for i, v in enumerate(rolled) if v >= target and i > 50), "b": 30}


def test_metrics_and_uplift(spark):
    df, rows = episodes(spark, {"a": 101, "b": 40})
    metrics = ev.policy_metrics(df)
    row = metrics.where("policy = 'a'").first()
    rewards = [r[4] for r in rows if r[0] == "a"]
    assert abs(row.std_reward - np.std(rewards)) < 1e-9
    assert abs(row.first_half_mean_reward - np.mean(rewards[:50])) < 1e-9
    assert abs(row.second_half_mean_reward - np.mean(rewards[50:])) < 1e-9
    base = np.mean([r[4] for r in rows if r[0] == "b"])
    uplift = ev.policy_uplift(metrics, ["b"]).where("policy = 'a'").first().uplift_vs_b_pct
    assert abs(uplift - (np.mean(rewards) - base) / base * 100) < 1e-9


def test_dense_index_across_ranges(spark):
    df = spark.range(0, 1000, 3).withColumn("k", (F.col("id") % 2).cast("string"))
    rows = bd.dense_index(df, "k", "id", "n", chunk_rows=50).orderBy("id").collect()
    for k in "01":
        assert [r.n for r in rows if r.k == k] == list(range(sum(r.k == k for r in rows)))


def test_dense_index_with_sparse_ids(spark):
    df = spark.range(0, 1000, 3).select((F.col("id") * (1 << 22)).alias("id"), F.lit("a").alias("k"))
    numbered = bd.dense_index(df, "k", "id", "n", chunk_rows=50)
    assert [r.n for r in numbered.orderBy("id").collect()] == list(range(334))


def test_reference_policy(spark):
    rows = [(70.0, 4, 8), (70.0, 5, 13), (69.0, 4, 13), (55.0, 7, 4), (40.0, 9, 4), (39.9, 1, 1), (29.9, 1, 0)]
    df = spark.createDataFrame(rows, "readiness_score double, fatigue int, want int")
    assert all(r.got == r.want for r in df.withColumn("got", ev.reference_policy()).collect())


def test_overtraining_penalty(spark):
    df = spark.createDataFrame([(35.0, 8, 3), (80.0, 2, 3)], "readiness_score double, fatigue int, intensity_rank int")
    got = [(r.mismatch, r.overtraining, round(r.base_score, 6)) for r in ev.with_intensity_mismatch(df).collect()]
    assert got == [(3, True, -0.45), (0, False, 0.8)]


def test_constant_metric_has_no_correlation(spark):
    rows = [(1, float(i), 5.0, float(-i), None, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "user_id int, readiness double, sleep double, hrv double, fatigue double, activity double")
    got = {(r.metric_a, r.metric_b): r.r for r in hi.metric_correlations(df).collect()}
    assert got["readiness", "sleep"] is None and got["readiness", "fatigue"] is None
    assert abs(got["readiness", "hrv"] + 1) < 1e-12
    best = hi.strongest_correlation(hi.metric_correlations(df)).first()
    assert (best.metric_a, best.metric_b) == ("readiness", "hrv")


def test_flatten_takes_defaults_and_top_level_plans(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 9), (80.0, None), "Strength")]
    df = spark.createDataFrame(
        rows, "user_id int, timestamp timestamp, state struct<readiness_score: double, mood: int>, workout_type string"
    )
    row = hi.flatten_history(df).first()
    assert (row.workout, row.intensity, row.duration, row.readiness, row.mood, row.stress, row.hrv) == (
        "Strength", "N/A", 0, 80.0, 5.0, 5.0, 0.0,
    )


def test_week_starts_on_monday(spark):
    rows = [(1, dt.datetime(2024, 1, 7, 23), 10), (1, dt.datetime(2024, 1, 8, 0), 20)]
    df = spark.createDataFrame(rows, "user_id int, timestamp timestamp, duration int")
    got = {r.week_start: r.minutes for r in hi.weekly_volume(df).collect()}
    assert got == {dt.date(2024, 1, 1): 10, dt.date(2024, 1, 8): 20}


def test_validation_splits_rows(spark):
    rows = [(50.0, 50.0, 50.0, 60.0, 50.0, 5), (90.0, 50.0, 5.0, 101.0, None, 9), (101.0, 1.0, 50.0, 60.0, 1.0, 9)]
    df = spark.createDataFrame(
        rows,
        "readiness_score double, sleep_score double, hrv double, resting_hr double, activity_score double, fatigue int",
    )
    checked = ql.validate(df, "body_state")
    assert [r.violations for r in checked.collect()] == [
        [],
        ["activity_score_missing", "hrv_range", "resting_hr_range", "high_readiness_high_fatigue"],
        ["readiness_score_range"],
    ]
    valid, bad = ql.split_valid(checked)
    assert (valid.count(), bad.count()) == (1, 2)


def test_required_column_that_is_absent(spark):
    checked = ql.validate(spark.createDataFrame([(1,)], "user_id int"), "feedback")
    assert checked.first().violations == ["thumbs_up_missing"]
