"""Queries over history, training logs and data quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulseframe.operators import history as hi
from pulseframe.operators import quality as ql
from pulseframe.plans.ingest import FLAT_DOUBLES, history
from pulseframe.plans.inputs import source
from pulseframe.plans.oracle_parts import ACTIONS, HISTORY
from pulseframe.plans.registry import query

FLAT = {"actions": ACTIONS, "flat0": HISTORY, "flat": "select *, hrv0 as hrv from flat0"}


def flat(spark, folder):
    return hi.flatten_history(history(spark, folder))


VIEW = "user_id, date_str, workout, intensity, duration, readiness, sleep, hrv, rhr, fatigue, activity, mood, stress"


@query("flatten_history", f"select {VIEW} from flat", "decisions", FLAT_DOUBLES, FLAT)
def flatten_history(spark, folder):
    return flat(spark, folder).drop("timestamp")


@query(
    "history_on_date",
    f"select {VIEW} from flat where cast(timestamp as date) = date '2024-01-15'",
    "decisions",
    FLAT_DOUBLES,
    FLAT,
)
def history_on_date(spark, folder):
    return hi.on_date(flat(spark, folder), dt.date(2024, 1, 15)).drop("timestamp")


RECENT = """select *, row_number() over (partition by user_id order by timestamp desc) as recency from flat"""


@query(
    "last_n_records",
    f"select {VIEW}, recency from recent where recency <= 14",
    "decisions",
    FLAT_DOUBLES,
    {**FLAT, "recent": RECENT},
)
def last_n_records(spark, folder):
    recent = hi.last_n(flat(spark, folder), 14, ["timestamp"]).drop("timestamp")
    return recent.withColumn("recency", F.col("recency").cast("bigint"))


@query(
    "last7_summary",
    """select user_id, avg(readiness) as avg_readiness, avg(hrv) as avg_hrv, avg(sleep) as avg_sleep,
       case when count(*) > 1 then max(readiness) filter (recency = 1) - avg(readiness) end as delta_readiness,
       case when count(*) > 1 then max(hrv) filter (recency = 1) - avg(hrv) end as delta_hrv,
       case when count(*) > 1 then max(sleep) filter (recency = 1) - avg(sleep) end as delta_sleep,
       cast(sum(duration) as bigint) as total_duration, max(duration) filter (recency = 1) as latest_duration
       from recent where recency <= 7 group by user_id""",
    "decisions",
    "avg_readiness avg_hrv avg_sleep delta_readiness delta_hrv delta_sleep",
    {**FLAT, "recent": RECENT},
)
def last7_summary(spark, folder):
    return hi.last7_summary(flat(spark, folder))


PAIRS = [
    ("readiness", "sleep"),
    ("readiness", "hrv"),
    ("readiness", "fatigue"),
    ("readiness", "activity"),
    ("sleep", "hrv"),
    ("sleep", "fatigue"),
    ("sleep", "activity"),
    ("hrv", "fatigue"),
    ("hrv", "activity"),
    ("fatigue", "activity"),
]
CORRELATIONS = " union all ".join(
    f"""select user_id, '{a}' as metric_a, '{b}' as metric_b,
        round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) + 0e0 as r
        from recent where recency <= 30 group by user_id"""
    for a, b in PAIRS
)


def recent_correlations(spark, folder):
    recent = hi.last_n(flat(spark, folder), 30, ["timestamp"])
    return hi.metric_correlations(recent).withColumn("r", F.round("r", 6))


@query(
    "metric_correlations", "select * from correlations", "decisions", "", {**FLAT, "recent": RECENT, "correlations": CORRELATIONS}
)
def metric_correlations(spark, folder):
    return recent_correlations(spark, folder)


@query(
    "strongest_correlation",
    """select user_id, metric_a, metric_b, r from correlations where r is not null
       qualify row_number() over (partition by user_id order by r desc, metric_a, metric_b) = 1""",
    "decisions",
    "",
    {**FLAT, "recent": RECENT, "correlations": CORRELATIONS},
)
def strongest_correlation(spark, folder):
    """Ranked by the rounded value, so that equal correlations tie."""
    return hi.strongest_correlation(recent_correlations(spark, folder))


@query(
    "weekly_volume",
    """select user_id, cast(date_trunc('week', timestamp) as date) as week_start, cast(sum(duration) as bigint) as minutes
       from flat group by 1, 2""",
    "decisions",
    "",
    FLAT,
)
def weekly_volume(spark, folder):
    return hi.weekly_volume(flat(spark, folder))


@query(
    "mood_trend",
    """select user_id, avg(coalesce(mood, 3)) as avg_mood, avg(coalesce(mood, 3)) < 3 as suggest_lighter,
       count(*) filter (completion = 1) as completed_days from states group by user_id""",
    "states",
    "avg_mood",
)
def mood_trend(spark, folder):
    return hi.mood_trend(source(spark, folder, "states"))


@query(
    "workout_distribution",
    """select user_id, workout, count(*) as row_count, count(*) / sum(count(*)) over (partition by user_id) as share
       from flat group by user_id, workout""",
    "decisions",
    "share",
    FLAT,
)
def workout_distribution(spark, folder):
    return hi.value_shares(flat(spark, folder), "workout")


@query(
    "session_summary",
    """select user_id, count(distinct date) as total_sessions, count(*) as total_exercises, avg(fatigue) as avg_fatigue,
       avg(motivation) as avg_motivation, avg(muscle_soreness) as avg_muscle_soreness from sessions group by user_id""",
    "sessions",
    "avg_fatigue avg_motivation avg_muscle_soreness",
)
def session_summary(spark, folder):
    return hi.session_summary(source(spark, folder, "sessions"))


@query(
    "top_exercises",
    """select user_id, exercise_name, count(*) as row_count,
         cast(row_number() over (partition by user_id order by count(*) desc, exercise_name) as integer) as position
       from sessions group by user_id, exercise_name
       qualify row_number() over (partition by user_id order by count(*) desc, exercise_name) <= 10""",
    "sessions",
)
def top_exercises(spark, folder):
    return hi.top_exercises(source(spark, folder, "sessions"))


@query(
    "recent_sessions",
    """select user_id, session_id, cast(date as date) as date, exercise_name, sets, reps, weight_kg, rpe from sessions
       where date >= timestamp '2001-08-01 00:00:00' - interval 30 days""",
    "sessions",
    "weight_kg",
)
def recent_sessions(spark, folder):
    recent = hi.since(source(spark, folder, "sessions"), dt.datetime(2001, 8, 1), 30)
    columns = ["exercise_name", "sets", "reps", "weight_kg", "rpe"]
    return recent.select("user_id", "session_id", F.to_date("date").alias("date"), *columns)


def _text(df):
    return df.withColumn("violations", F.array_join("violations", ","))


def violations(rules: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"case when {fails} then '{code}' end" for code, fails in rules)
    return f"concat_ws(',', {cases})"


BODY_RULES = [
    *[
        (f"{c}_missing", f"{c} is null")
        for c in ("readiness_score", "sleep_score", "hrv", "resting_hr", "activity_score", "fatigue")
    ],
    *[
        (f"{c}_range", f"{c} not between {low} and {high}")
        for c, low, high in (
            ("readiness_score", 0, 100),
            ("sleep_score", 0, 100),
            ("hrv", 10, 150),
            ("resting_hr", 40, 100),
            ("activity_score", 0, 100),
            ("fatigue", 1, 10),
            ("mood", 1, 10),
            ("stress", 1, 10),
        )
    ],
    ("high_readiness_high_fatigue", "readiness_score between 0 and 100 and readiness_score > 80 and fatigue > 7"),
    ("low_readiness_low_fatigue", "readiness_score < 40 and fatigue between 1 and 2"),
]
BODY = {"checked_states": f"select user_id, date, {violations(BODY_RULES)} as violations from states"}


@query(
    "validate_body_state",
    "select user_id, date, violations, violations = '' as is_valid from checked_states",
    "states",
    extra=BODY,
)
def validate_body_state(spark, folder):
    checked = ql.validate(source(spark, folder, "states"), "body_state")
    return _text(checked).select("user_id", "date", "violations", "is_valid")


@query(
    "quarantine_counts",
    """select violation, count(*) as row_count
       from (select unnest(string_split(violations, ',')) as violation from checked_states where violations <> '') v
       group by violation""",
    "states",
    extra=BODY,
)
def quarantine_counts(spark, folder):
    return ql.quarantine_counts(ql.validate(source(spark, folder, "states"), "body_state"))


PROFILE_RULES = [
    ("age_range", "age not between 18 and 100"),
    ("weight_range", "weight not between 30 and 300"),
    ("height_range", "height not between 100 and 250"),
    (
        "fitness_goal_domain",
        "fitness_goal not in ('strength', 'endurance', 'weight_loss', 'muscle_gain', 'general_fitness')",
    ),
]


@query(
    "validate_profile",
    f"select user_id, violations, violations = '' as is_valid from (select user_id, {violations(PROFILE_RULES)} as violations from profiles) p",
    "profiles",
)
def validate_profile(spark, folder):
    checked = ql.validate(source(spark, folder, "profiles"), "profile")
    return _text(checked).select("user_id", "violations", "is_valid")


WORKOUTS = ", ".join(f"'{w}'" for w in ql.WORKOUT_DOMAIN)
FEEDBACK_RULES = [
    ("thumbs_up_missing", "thumbs_up is null"),
    ("actual_duration_range", "actual_duration not between 0 and 300"),
    ("comment_length", "length(comment) > 500"),
    ("actual_workout_domain", f"actual_workout not in ({WORKOUTS})"),
]


@query(
    "validate_feedback",
    f"""select user_id, turn, violations, violations = '' as is_valid
        from (select user_id, turn, {violations(FEEDBACK_RULES)} as violations from form_feedback) f""",
    "form_feedback",
)
def validate_feedback(spark, folder):
    checked = ql.validate(source(spark, folder, "form_feedback"), "feedback")
    return _text(checked).select("user_id", "turn", "violations", "is_valid")


PLANNED = """select c_custkey as user_id, case when c_nationkey % 3 = 0 then 'Rest Day' when c_nationkey % 3 = 1
    then 'Cardio (Steady State)' else c_mktsegment end as workout_type,
  case c_custkey % 5 when 0 then 'low' when 1 then 'moderate' when 2 then 'high' when 3 then 'very_high' end as intensity,
  cast(c_custkey % 200 - 5 as int) as duration_minutes, c_acctbal / 8000 as confidence,
  cast(c_custkey % 320 as int) as actual_duration,
  case c_custkey % 3 when 0 then 'api' when 1 then 'oura_ring' else 'fax' end as source from {customer}"""


def planned(spark, folder):
    return spark.sql(PLANNED, customer=source(spark, folder, "customer"))


RECOMMENDATION_RULES = [
    ("workout_type_missing", "workout_type is null"),
    ("intensity_missing", "intensity is null"),
    ("duration_minutes_missing", "duration_minutes is null"),
    ("duration_minutes_range", "duration_minutes not between 0 and 180"),
    ("confidence_range", "confidence not between 0 and 1"),
    ("workout_type_domain", f"workout_type not in ({WORKOUTS})"),
    ("intensity_domain", "intensity not in ('low', 'moderate', 'high', 'very_high')"),
]


@query(
    "validate_recommendation",
    f"""select user_id, violations, violations = '' as is_valid
        from (select user_id, {violations(RECOMMENDATION_RULES)} as violations from planned) p""",
    extra={"planned": PLANNED.format(customer="customer")},
)
def validate_recommendation(spark, folder):
    checked = ql.validate(planned(spark, folder).drop("source"), "recommendation")
    return _text(checked).select("user_id", "violations", "is_valid")


ENTRY_RULES = [
    ("actual_duration_range", "actual_duration not between 0 and 300"),
    ("workout_type_domain", f"workout_type not in ({WORKOUTS})"),
    (
        "source_domain",
        "source not in ('manual_upload', 'csv_upload', 'json_upload', 'api', 'apple_health', 'oura_ring')",
    ),
]


@query(
    "validate_training_entry",
    f"""select user_id, violations, violations = '' as is_valid
        from (select user_id, {violations(ENTRY_RULES)} as violations from planned) p""",
    extra={"planned": PLANNED.format(customer="customer")},
)
def validate_training_entry(spark, folder):
    checked = ql.validate(planned(spark, folder), "training_entry")
    return _text(checked).select("user_id", "violations", "is_valid")


@query(
    "user_bmi",
    "select user_id, round(weight / pow(height / 100, 2), 2) as bmi from profiles",
    "profiles",
    "bmi",
)
def user_bmi(spark, folder):
    return source(spark, folder, "profiles").select("user_id", ql.bmi().alias("bmi"))
