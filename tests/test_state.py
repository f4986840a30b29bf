"""States put together from tables that change on their own, and ranges of equal size."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import bounded, daily, evaluate, safety
from pulseframe.operators import state as st

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_as_of_takes_the_last_fact_and_never_a_later_one(spark):
    pick = random.Random(5)
    rows = [(u, day(n), n * 10 + u) for u in range(4) for n in range(0, 40, 1 + u)] + [(None, day(3), 1)]
    facts = [(pick.randint(0, 4), day(pick.randint(0, 39)), pick.choice([None, 1, 2, 3]), pick.choice([None, "x", "y"])) for _ in range(60)]
    expected = set()
    for user, at, number in rows:
        found = []
        for c in (2, 3):
            mine = [f for f in facts if f[0] == user and f[1] <= at and f[c] is not None]
            last = max(mine, key=lambda f: (f[1], f[2] is not None, f[2] or 0, f[3] is not None, f[3] or ""), default=None)
            found.append(last[c] if last and (at - last[1]).days <= 5 else None)
        expected.add((user, at, number, *found))
    left = spark.createDataFrame(rows, "user_id int, date date, number int")
    right = spark.createDataFrame(facts, "user_id int, date date, a int, b string")
    got = st.as_of(left, right, "user_id", "date", "date", ("a", "b"), 5)
    assert got.columns == ["user_id", "date", "number", "a", "b"]
    assert set(map(tuple, got.collect())) == expected and got.count() == len(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_state_holds_every_column_that_is_checked(spark):
    schema = "user_id int, date date, resting_hr double, hrv double, active_calories double, sleep_duration_hours double, readiness_score double, overtraining_risk boolean, completion int, rpe double"
    measured = spark.createDataFrame([(1, day(n), 60.0, 50.0, 500.0, 8.0, 80.0, False, 1, 5.0) for n in range(4)], schema)
    reports = spark.createDataFrame([(1, day(1), 9, 5, 2, 1, 4)], "user_id int, date date, fatigue int, motivation int, soreness int, stress int, mood int")
    profiles = spark.createDataFrame([(1, day(2), "strength", "bulking", ["knee"])], "user_id int, date date, primary_goal string, current_phase string, injury_history array<string>")
    states = st.require_checked(st.daily_state(measured, reports, profiles))
    rows = {r.date: r for r in safety.assess(states).collect()}
    assert [rows[day(n)].fatigue for n in range(4)] == [None, 9, 9, 9]
    assert [rows[day(n)].primary_goal for n in range(4)] == [None, None, "strength", "strength"]
    assert [rows[day(n)].training_frequency_last_week for n in range(4)] == [1, 2, 3, 4]
    assert rows[day(0)].is_safe and rows[day(2)].message.startswith("High training frequency detected (3")
    with pytest.raises(ValueError, match="training_frequency_last_week"):
        st.require_checked(states.drop("training_frequency_last_week"))


def test_ranges_hold_few_rows_where_ids_lie_in_far_clusters(spark):
    """Two clusters of ids at both ends of their range, one key with nearly all rows."""
    low = spark.range(30_000).select(F.lit("hot").alias("policy"), F.col("id"))
    far = spark.range(30_000).select(F.lit("hot").alias("policy"), (F.col("id") * 3 + 2**62).alias("id"))
    few = spark.createDataFrame([("small", -5), ("small", 7), ("single", 2**62)], "policy string, id long")
    log = low.unionByName(far).unionByName(few)
    sizes = bounded.equal_ranges(log, "policy", "id", chunk_rows=1000).groupBy("policy", "_range", "_part").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2000
    numbered = bounded.dense_index(log, "policy", "id", "n", chunk_rows=1000)
    wrong = numbered.where("policy = 'hot'").where("n != CASE WHEN id < 30000 THEN id ELSE 30000 + (id - 4611686018427387904) div 3 END")
    assert wrong.count() == 0 and numbered.count() == log.count()
    assert sorted((r.policy, r.n) for r in numbered.where("policy != 'hot'").collect()) == [("single", 0), ("small", 0), ("small", 1)]


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (\w+\([^)]*\))", text), text


def test_the_log_is_not_shuffled_by_policy(spark):
    """What is shuffled by policy alone are counts and sums made where rows are read."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    log = spark.range(100).select(F.lit("p").alias("policy"), F.col("id").alias("event"), F.col("id").cast("double").alias("reward"))
    log = log.withColumns({"action_id": F.lit(1), "optimal_action_id": F.lit(1), "is_overtraining": F.lit(False), "episode": F.col("event")})
    for df in (evaluate.policy_metrics(log), evaluate.convergence_episode(log), bounded.dense_index(log, "policy", "event", "n")):
        _, text = exchanges(df)
        lines = text.split("\n")
        for n, line in enumerate(lines):
            if re.search(r"Exchange hashpartitioning\(policy#\d+L?, \d+\)", line):
                assert "partial" in lines[n + 1] or "HashAggregate" in lines[n + 1] or "_n#" in line, line
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_three_sources_meet_in_one_shuffle(spark):
    sources = {
        name: spark.createDataFrame([(1, day(n), float(n), f"{name}{n}")], f"user_id int, date date, hrv double, note_{name} string")
        for n, name in enumerate(("a", "b", "c"))
    }
    both = daily.unify(sources)
    found, _ = exchanges(both)
    assert len(found) == 1
    rows = {r.date: r for r in both.collect()}
    assert [rows[day(n)].hrv for n in range(3)] == [0.0, 1.0, 2.0]
    assert (rows[day(1)].hrv_a, rows[day(1)].hrv_b, rows[day(1)].note_b, rows[day(1)].note_c) == (None, 1.0, "b1", None)
