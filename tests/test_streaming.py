"""Streams in several micro-batches: restarts, repeats and late rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pulseframe.operators.posterior import beta_posterior
from pulseframe.operators.reward import with_reward
from pulseframe.streaming import jobs, runner
from pulseframe.streaming.messages import feedback_messages, judged_feedback, parse_feedback
from pulseframe.streaming.runner import parquet_stream

FEEDBACK = "event_id int, timestamp timestamp, action_id int, completion double"
NOON = dt.datetime(2024, 1, 1, 12)


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def as_dict(df):
    return {r.action_id: (r.alpha, r.beta, r.action_count) for r in df.collect()}


def test_posterior_over_batches_equals_one_aggregate(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [(i, NOON, i % 18, float(i % 2)) for i in range(100)]
    land(spark, first, FEEDBACK, source)
    stream = lambda: parquet_stream(spark, source, spark.read.parquet(source).schema)
    jobs.stream_posterior(stream(), out)
    second = [(i, NOON, i % 5, 1.0) for i in range(100, 160)]
    land(spark, second, FEEDBACK, source)
    got = as_dict(jobs.stream_posterior(stream(), out))
    assert got == as_dict(beta_posterior(with_reward(spark.read.parquet(source))))
    assert len(spark.read.parquet(out).select("batch_id").distinct().collect()) >= 2


def test_repeated_feedback_counts_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, NOON, 3, 1.0) for i in range(10)]
    land(spark, rows, FEEDBACK, source)
    land(spark, rows, FEEDBACK, source)
    stream = parquet_stream(spark, source, spark.read.parquet(source).schema)
    got = as_dict(jobs.stream_posterior(stream, out, event_id="event_id"))
    assert got[3] == (11.0, 1.0, 10)


RECORD = "event_id int, user_id int, ts timestamp, type string, value double, duration double"


def test_daily_rows_are_updated_and_very_late_ones_dropped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    hour = dt.timedelta(hours=1)
    stream = lambda: parquet_stream(spark, source, spark.read.parquet(source).schema)
    land(spark, [(1, 1, NOON, "steps", 100.0, None)], RECORD, source)
    jobs.stream_daily(stream(), out)
    land(spark, [(2, 1, NOON + hour, "steps", 50.0, None), (1, 1, NOON, "steps", 100.0, None)], RECORD, source)
    jobs.stream_daily(stream(), out)
    land(spark, [(3, 1, NOON + 240 * hour, "steps", 7.0, None)], RECORD, source)
    jobs.stream_daily(stream(), out)
    land(spark, [(4, 1, NOON, "steps", 1000.0, None)], RECORD, source)
    got = {r.date: r.steps for r in jobs.stream_daily(stream(), out).collect()}
    assert got == {dt.date(2024, 1, 1): 150.0, dt.date(2024, 1, 11): 7.0}
    assert jobs.late_records(spark, out).first().late == 1


def test_recommendations_use_the_stored_posterior(spark, tmp_path):
    posterior = beta_posterior(
        spark.createDataFrame([(17, 1.0, 1)] * 3, "action_id int, reward double, success int")
    )
    posterior.write.parquet(str(tmp_path / "posterior" / "batch_id=0"))
    states = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), 60.0, 50.0, 8.0, 80.0, 3, 2, False, 0), (2, dt.date(2024, 1, 1), 60.0, 10.0, 8.0, 80.0, 3, 2, False, 0)],
        "user_id int, date date, resting_hr double, hrv double, sleep_duration_hours double, readiness_score double, "
        "fatigue int, soreness int, overtraining_risk boolean, consecutive_high_days int",
    )
    states.write.parquet(str(tmp_path / "states"))
    stream = parquet_stream(spark, str(tmp_path / "states"), states.schema)
    got = jobs.stream_recommendations(stream, str(tmp_path / "posterior"), str(tmp_path / "out"))
    assert {r.user_id: r.action_id for r in got.collect()} == {1: 17, 2: 0}


STATES = (
    "user_id int, date date, resting_hr double, hrv double, sleep_duration_hours double, readiness_score double, "
    "fatigue int, soreness int, overtraining_risk boolean, consecutive_high_days int"
)


def test_a_batch_tried_again_decides_alike(spark, tmp_path):
    """The posterior moves between two tries of a batch, and before the batch after it."""
    stored, out = str(tmp_path / "posterior"), str(tmp_path / "out")
    posterior = lambda action: beta_posterior(
        spark.createDataFrame([(action, 1.0, 1)] * 3, "action_id int, reward double, success int")
    )
    states = spark.createDataFrame([(1, dt.date(2024, 1, 1), 60.0, 50.0, 8.0, 80.0, 3, 2, False, 0)], STATES)
    decided = lambda n: [r.action_id for r in jobs.decide_batch(states, n, stored, out).collect()]
    posterior(17).write.parquet(f"{stored}/batch_id=0")
    assert decided(0) == [17]
    posterior(4).write.parquet(f"{stored}/batch_id=1")
    assert decided(0) == [17] and decided(1) == [4]


def test_states_without_a_needed_column_are_refused(spark, tmp_path):
    states = spark.createDataFrame([(1, 2)], "user_id int, fatigue int")
    with pytest.raises(ValueError, match="consecutive_high_days"):
        jobs.decide_batch(states, 0, str(tmp_path / "posterior"), str(tmp_path / "out"))


def test_many_batches_are_read_in_few_folders(spark, tmp_path):
    """A hundred batches: answers stay the same and few folders are left to read."""
    path = str(tmp_path / "days")
    expected = {}
    for n in range(100):
        rows = [(k, n * 10 + k) for k in range(n % 5, n % 5 + 3)]
        expected |= dict(rows)
        spark.createDataFrame(rows, "key int, value int").coalesce(1).write.parquet(runner.batch_path(path, n))
        runner.merge_batches(spark, path, runner.newest_per_key(["key"]))
    assert dict(map(tuple, runner.newest_rows(spark, path, ["key"]).select("key", "value").collect())) == expected
    assert len(list((tmp_path / "days").iterdir())) <= 2 * (runner.MERGE_AFTER + 2)
    assert len(list((tmp_path / "days-base").iterdir())) <= 2
    # A batch that runs again sees what it saw at first: the batches before it.
    assert runner.read_batches(spark, path, before=99).agg(F.max("batch_id")).first()[0] == 98


def test_messages_are_judged(spark):
    good = '{"event_type": "feedback_received", "action_id": 3, "feedback": {"completion": 1.0}}'
    cases = {
        good: None,
        good[:-9]: "unreadable",
        "": "unreadable",
        None: "unreadable",
        "[1, 2": "unreadable",
        good.replace("3", '"x"'): "wrong type",
        good.replace("1.0", '"much"'): "wrong type",
        good.replace("3", "18"): "unknown action",
        good.replace("3", "-1"): "unknown action",
        good.replace("3", "null"): "no action",
        '{"action_id": 3}': "no event type",
        "{}": "no event type",
    }
    rows = [(v, n) for n, v in enumerate(cases)] + [('{"event_type": "plan_served"}', 99)]
    found = judged_feedback(spark.createDataFrame(rows, "value string, offset int")).collect()
    assert {r.offset: r.reason for r in found} == dict(enumerate(cases.values()))


def test_a_batch_of_messages_run_again_changes_nothing(spark, tmp_path):
    """Late and repeated messages are kept apart; running the last batch again gives the same rows."""
    out = str(tmp_path / "out")

    def message(event, day, action=3):
        return (json.dumps({"event_type": "feedback_received", "event_id": event, "timestamp": f"2024-01-{day:02d}", "action_id": action}),)

    batches = [
        [message("a", 20), message("a", 20), message("b", 21)],
        [message("a", 20), message("c", 2), message("d", 22), message(None, 22), message(None, 22)],
        [message("d", 22), message("e", 11), ("broken",), message("f", 23, 40)],
    ]
    for _ in range(2):
        for n, rows in enumerate(batches):
            jobs.learn_batch(spark.createDataFrame(rows, "value string"), n, out, "10 DAYS")
        posterior, rejected = jobs.feedback_results(spark, out, ["value"])
        reasons = sorted((r.batch_id, r.reason) for r in rejected.collect())
        assert reasons == [(0, "repeated"), (1, "late"), (1, "repeated"), (2, "late"), (2, "repeated"), (2, "unknown action"), (2, "unreadable")]
        assert as_dict(posterior)[3][2] == 5


def test_alerts_only_for_unsafe_states(spark, tmp_path):
    states = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), 9, False), (2, dt.date(2024, 1, 1), 3, False)],
        "user_id int, date date, fatigue int, overtraining_risk boolean",
    ).withColumns({n: F.lit(None).cast("double") for n in ("resting_hr", "hrv", "sleep_duration_hours", "readiness_score", "soreness")})
    states.write.parquet(str(tmp_path / "states"))
    stream = parquet_stream(spark, str(tmp_path / "states"), states.schema)
    rows = jobs.stream_alerts(stream, str(tmp_path / "alerts")).collect()
    assert [(r.user_id, r.severity) for r in rows] == [(1, "critical")]


def test_messages_survive_a_round_trip(spark):
    rows = [(7, NOON, 3, 1.0, 0.5, True), (8, NOON, 4, None, None, None)]
    sent = spark.createDataFrame(
        rows, "user_id int, timestamp timestamp, action_id int, completion double, satisfaction double, overtraining boolean"
    )
    values = feedback_messages(with_reward(sent))
    noise = spark.createDataFrame([("t", "{broken"), ("t", '{"event_type": "plan_served", "action_id": 1}')], "topic string, value string")
    got = parse_feedback(values.union(noise)).orderBy("user_id").collect()
    assert [(r.user_id, r.action_id, r.completion, r.satisfaction, r.overtraining) for r in got] == [
        ("7", 3, 1.0, 0.5, True), ("8", 4, None, None, None),
    ]
    assert {r.topic for r in values.collect()} == {"training.user.feedback"}
