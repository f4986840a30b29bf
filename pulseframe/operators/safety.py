"""Safety checks of daily states and training plans, and the actions they leave open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.scalars import given, given_above, given_at_least, given_below, or_else
from pulseframe.operators.catalog import ALL_IDS, id_array, ids_of_intensity, ids_within

# Thresholds.
MIN_HRV = 20
MAX_RESTING_HR = 100
MIN_SLEEP_HOURS = 4
MIN_READINESS = 50
MAX_CONSECUTIVE_HIGH_DAYS = 3
MAX_FATIGUE = 8
MAX_SORENESS = 8
PLAN_FATIGUE = 7

# Severities from worst to best and the action lists each limit leaves.
SEVERITY = ("critical", "high", "medium", "low")
REST_ONLY = [0]
REST_OR_RECOVERY = ids_within(("REST", "RECOVERY"), "LOW")
UP_TO_MEDIUM = ids_within(max_intensity="MEDIUM")
UP_TO_LOW = sorted(ids_of_intensity("NONE") + ids_of_intensity("LOW"))

# The checks of a state in order, with severity, recommended action and message.
STATE_CHECKS = {
    "signals": (
        "high",
        "rest_day_or_light_activity",
        "Abnormal physiological signals detected: {}",
    ),
    "overtraining": (
        "critical",
        "mandatory_rest_day",
        "Overtraining risk detected. Multiple indicators suggest excessive training load.",
    ),
    "frequency": (
        "high",
        "reduce_intensity_or_rest",
        "High training frequency detected ({} days/week)",
    ),
    "fatigue": (
        "high",
        "rest_day_or_recovery_session",
        "High fatigue level ({}/10). Training may be counterproductive.",
    ),
    "sleep": (
        "medium",
        "light_training_or_rest",
        "Insufficient sleep ({} hours). Recovery may be compromised.",
    ),
    "readiness": (
        "medium",
        "reduce_intensity",
        "Low readiness score ({}/100). Consider lighter training.",
    ),
    "soreness": (
        "high",
        "active_recovery_or_rest",
        "High muscle soreness ({}/10). Risk of injury if training intensively.",
    ),
    "clear": ("low", "proceed_with_plan", "All safety checks passed"),
}
FAST_PULSE = "Resting heart rate elevated ({} bpm)"
LOW_HRV = "HRV very low ({} ms)"

# The checks of a plan, in the same form.
PLAN_CHECKS = {
    "too_hard": ("high", "reduce_intensity", "High intensity plan requested but fatigue level is elevated"),
    "injury": ("critical", "modify_plan", "Plan includes exercise that may aggravate injury history: {}"),
    "clear": ("low", "proceed", "Plan is safe given current state"),
}

# Type, severity, action and text of an alert.
ALERT_TYPE, ALERT_SEVERITY = "safety_alert", "critical"
ALERT_ACTION = "stop_training_and_consult_professional"
ALERT_TEXT = (
    "⚠️ SAFETY ALERT: {}\n\nPlease stop training and consult with a healthcare professional if you experience: "
    "chest pain, dizziness, severe discomfort, or abnormal heart rate patterns."
)

OUTCOME = ("is_safe", "risk_level", "message", "recommended_action")


def fill(template: str, value: Column | None = None) -> Column:
    """The template with its placeholder replaced by a column."""
    if value is None:
        return F.lit(template)
    before, after = template.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def _finding(checks: dict, name: str, value: Column | None = None) -> Column:
    """The result of a check; structs order by severity first, then by place in the list."""
    severity, action, message = checks[name]
    return F.struct(
        F.lit(SEVERITY.index(severity)).alias("rank"),
        F.lit(list(checks).index(name)).alias("place"),
        F.lit(severity == "low").alias("is_safe"),
        F.lit(severity).alias("risk_level"),
        fill(message, value).alias("message"),
        F.lit(action).alias("recommended_action"),
    )


def _state_findings(columns: list[str]) -> list[Column]:
    """One nullable finding per check that the columns allow."""
    fast_pulse, low_hrv = given_above("resting_hr", MAX_RESTING_HR), given_below("hrv", MIN_HRV)
    signals = F.concat_ws(
        "; ",
        F.when(fast_pulse, fill(FAST_PULSE, F.col("resting_hr"))),
        F.when(low_hrv, fill(LOW_HRV, F.col("hrv"))),
    )
    fails = {
        "signals": (fast_pulse | low_hrv, signals),
        "overtraining": (F.col("overtraining_risk"), None),
        "fatigue": (given_at_least("fatigue", MAX_FATIGUE), F.col("fatigue")),
        "sleep": (given_below("sleep_duration_hours", MIN_SLEEP_HOURS), F.col("sleep_duration_hours")),
        "readiness": (given_below("readiness_score", MIN_READINESS), F.col("readiness_score")),
        "soreness": (given_at_least("soreness", MAX_SORENESS), F.col("soreness")),
    }
    if "training_frequency_last_week" in columns:
        frequency = F.col("training_frequency_last_week")
        fails["frequency"] = (given_at_least(frequency, MAX_CONSECUTIVE_HIGH_DAYS), frequency)
    return [F.when(failing, _finding(STATE_CHECKS, name, value)) for name, (failing, value) in fails.items()]


def _worst(findings: list[Column], all_clear: Column) -> Column:
    return F.array_min(F.array(*findings, all_clear))


def _with_outcome(df: DataFrame, worst: Column) -> DataFrame:
    checked = df.withColumn("_worst", worst)
    return checked.withColumns({name: F.col(f"_worst.{name}") for name in OUTCOME}).drop("_worst")


def assess(states: DataFrame) -> DataFrame:
    """Add the outcome of the most severe failing check; the earlier check wins a tie.

    Reads resting_hr, hrv, fatigue, soreness, sleep_duration_hours, readiness_score,
    overtraining_risk and, when present, training_frequency_last_week. Zero counts as not
    reported.
    """
    return _with_outcome(states, _worst(_state_findings(states.columns), _finding(STATE_CHECKS, "clear")))


def allowed_coded(states: DataFrame) -> DataFrame:
    """Add ``allowed`` from the recommended action of ``assess``."""
    action = F.col("recommended_action")
    allowed = (
        F.when(action == "mandatory_rest_day", id_array(REST_ONLY))
        .when(action == "rest_day_or_light_activity", id_array(REST_OR_RECOVERY))
        .when(action == "reduce_intensity", id_array(UP_TO_MEDIUM))
        .otherwise(id_array(ALL_IDS))
    )
    return states.withColumn("allowed", allowed)


def allowed_declared(states: DataFrame) -> DataFrame:
    """Add ``allowed`` as the intersection of every limit that applies.

    The limits are nested, so the intersection is the tightest one. ``consecutive_high_days``
    is required, as a limit must not vanish with a column; where the run isn't known it is null.
    """
    rest_or_recovery = (
        given_above("resting_hr", MAX_RESTING_HR)
        | given_below("hrv", MIN_HRV)
        | given_below("sleep_duration_hours", MIN_SLEEP_HOURS)
        | given_at_least("fatigue", MAX_FATIGUE)
        | given_at_least("soreness", MAX_SORENESS)
    )
    medium = given_below("readiness_score", MIN_READINESS)
    medium = medium | given_at_least("consecutive_high_days", MAX_CONSECUTIVE_HIGH_DAYS)
    allowed = (
        F.when(F.col("overtraining_risk"), id_array(REST_ONLY))
        .when(rest_or_recovery, id_array(REST_OR_RECOVERY))
        .when(medium, id_array(UP_TO_MEDIUM))
        .otherwise(id_array(ALL_IDS))
    )
    return states.withColumn("allowed", allowed)


def allowed_minimal(states: DataFrame) -> DataFrame:
    """Add ``allowed`` from readiness and fatigue alone; here zero is a value."""
    readiness, fatigue = or_else("readiness_score", 50), or_else("fatigue", 5)
    allowed = (
        F.when((readiness < 30) | (fatigue > 8), id_array(ids_within(("REST", "RECOVERY"))))
        .when(fatigue > 6, id_array(UP_TO_LOW))
        .otherwise(id_array(ALL_IDS))
    )
    return states.withColumn("allowed", allowed)


PROFILES = {"declared": allowed_declared, "coded": allowed_coded, "minimal": allowed_minimal}


def with_allowed(states: DataFrame, profile: str = "declared") -> DataFrame:
    """Assess the states and add the allowed actions of a safety profile."""
    return PROFILES[profile](assess(states))


def _plan_too_hard() -> Column:
    high = F.coalesce("intensity", F.lit("moderate")) == "high"
    return F.when(high & given_at_least("fatigue", PLAN_FATIGUE), _finding(PLAN_CHECKS, "too_hard"))


def _aggravates(name: Column) -> Column:
    return F.exists(F.col("injuries"), lambda term: F.contains(name, F.lower(term)))


def _plan_outcome(plans: DataFrame, first_hit: Column) -> DataFrame:
    """The intensity finding decides before the exercise finding, whatever its severity."""
    injury = F.when(first_hit.isNotNull(), _finding(PLAN_CHECKS, "injury", first_hit))
    return _with_outcome(plans, F.coalesce(_plan_too_hard(), injury, _finding(PLAN_CHECKS, "clear")))


def plan_safety(plan_exercises: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """Plan check over one row per exercise.

    Plan-level columns (intensity, fatigue, injuries) repeat on each row. The first
    exercise that names an injury is found by an aggregate, so no plan is collected.
    """
    name = F.lower("exercise_name")
    hits = plan_exercises.withColumn("_hit", F.when(_aggravates(name), F.struct(F.col(position), name.alias("name"))))
    plans = hits.groupBy(*keys, "intensity", "fatigue", "injuries").agg(F.min("_hit").alias("_hit"))
    return _plan_outcome(plans, F.col("_hit.name")).drop("_hit")


def plan_safety_nested(plans: DataFrame) -> DataFrame:
    """Plan check over plans that arrive as documents with an ``exercises`` array of structs."""
    names = F.transform(F.coalesce("exercises", F.array()), lambda e: F.lower(e["name"]))
    return _plan_outcome(plans, F.get(F.filter(names, _aggravates), F.lit(0)))


def adjust_plan(plans: DataFrame) -> DataFrame:
    """Lower a plan's intensity and volume as its ``recommended_action`` asks."""
    action, level = F.col("recommended_action"), F.col("intensity")
    light = action == "rest_day_or_light_activity"
    step_down = F.when(level == "high", "moderate").when(level == "moderate", "low").otherwise(level)
    return plans.withColumns(
        {
            "intensity": F.when(light, "low").when(action == "reduce_intensity", step_down).otherwise(level),
            "volume": F.when(light, "low").otherwise(F.col("volume")),
        }
    )


def safety_alerts(assessed: DataFrame) -> DataFrame:
    """One alert per unsafe state."""
    return assessed.where(~F.col("is_safe")).select(
        F.lit(ALERT_TYPE).alias("type"),
        F.lit(ALERT_SEVERITY).alias("severity"),
        "user_id",
        "date",
        F.col("message").alias("reason"),
        F.lit(ALERT_ACTION).alias("recommended_action"),
        fill(ALERT_TEXT, F.col("message")).alias("message"),
    )


def mood_class(mood: Column | str = "mood", stress: Column | str = "stress") -> Column:
    """How to respond to a mood check-in."""
    mood = F.col(mood) if isinstance(mood, str) else mood
    stress = F.col(stress) if isinstance(stress, str) else stress
    return F.when((mood <= 2) | (stress >= 4), "gentle").when(mood >= 4, "push").otherwise("neutral")


# Metrics of the summary in order, with their texts, and the text when none is reported.
SUMMARY = {
    "readiness_score": "Readiness score: {}/100",
    "sleep_score": "Sleep quality: {}/100",
    "resting_hr": "Resting heart rate: {} bpm",
    "days_since_training": "Last trained {} days ago",
    "fatigue": "Fatigue level: {}/10",
    "motivation": "Motivation level: {}/10",
    "mood": "Mood score: {}/5",
}
NO_SUMMARY = "No data available"


def state_summary(columns: list[str]) -> Column:
    """One line of text over the reported metrics of a state; zero is reported only for days since training."""
    shown = lambda name: F.col(name).isNotNull() if name == "days_since_training" else given(name)
    parts = [F.when(shown(name), fill(text, F.col(name))) for name, text in SUMMARY.items() if name in columns]
    text = F.concat_ws(". ", *parts)
    return F.when(text == "", NO_SUMMARY).otherwise(text)


# Groups and fields of the nested state record.
STATE_GROUPS = {
    "physiological": ("hrv", "resting_hr", "sleep_duration_hours", "sleep_score", "readiness_score"),
    "activity": ("steps", "active_calories"),
    "training": (
        "days_since_training",
        "training_frequency_last_week",
        "avg_rpe_last_week",
        "completion_rate_last_week",
    ),
    "user_feedback": ("fatigue", "motivation", "soreness", "stress", "mood"),
    "goals": ("primary_goal", "current_phase"),
    "safety": ("injury_history", "overtraining_risk"),
}


# Types of the nested state's fields that are not whole numbers.
STATE_TYPES = {
    "hrv": "double",
    "resting_hr": "double",
    "sleep_duration_hours": "double",
    "sleep_score": "double",
    "readiness_score": "double",
    "steps": "double",
    "active_calories": "double",
    "training_frequency_last_week": "double",
    "avg_rpe_last_week": "double",
    "completion_rate_last_week": "double",
    "primary_goal": "string",
    "current_phase": "string",
    "injury_history": "array<string>",
    "overtraining_risk": "boolean",
}


def nested_state(states: DataFrame) -> Column:
    """The state as a record of six groups of fixed types; fields the input lacks are NULL."""
    known = states.columns
    field = lambda n: (F.col(n) if n in known else F.lit(None)).cast(STATE_TYPES.get(n, "int")).alias(n)
    groups = [F.struct(*[field(n) for n in names]).alias(group) for group, names in STATE_GROUPS.items()]
    return F.struct("user_id", "date", *groups)
