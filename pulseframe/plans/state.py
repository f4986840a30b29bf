"""Queries over states put together from daily measures, self-reports and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions.scalars import to_places
from pulseframe.operators import policy as po
from pulseframe.operators import safety as sf
from pulseframe.operators import state as st
from pulseframe.plans.daily import EXPORT_DAILY, health_export_measures
from pulseframe.plans.decisions import GREEDY, KEYS, beta
from pulseframe.plans.inputs import source
from pulseframe.plans.oracle_parts import ACTIONS, ALLOWED_DECLARED_LOAD, ASSESSED, LOAD_STATES, POSTERIOR, RATIONALE, SINCE_STATES
from pulseframe.plans.registry import query

# The last report that tells of the field, on the day or up to three days before; the last profile that does.
_SAID = "(r.date, " + ", ".join(f"coalesce(r.{c}, -1)" for c in sorted(st.REPORTED)) + ")"
_REPORT = ", ".join(
    f"(select arg_max(r.{c}, {_SAID}) from reports r where r.user_id = d.user_id and r.date between d.date - 3 and d.date "
    f"and r.{c} is not null) as {c}"
    for c in st.REPORTED
)
_TOLD = "(p.date, coalesce(p.current_phase, ''), coalesce(array_to_string(p.injury_history, ','), ''), coalesce(p.primary_goal, ''))"
_PROFILE = ", ".join(
    f"(select arg_max(p.{c}, {_TOLD}) from profile_changes p where p.user_id = d.user_id and p.date <= d.date "
    f"and p.{c} is not null) as {c}"
    for c in st.PROFILE
)
# Needs measured, reports and profile_changes.
STATE = {
    "measured_since": SINCE_STATES.replace("from states)", "from measured)"),
    "measured_load": LOAD_STATES.replace("from states)", "from measured_since)"),
    "trained": """select *, cast(sum(cast(completion is not distinct from 1 as integer)) over w as bigint) as training_frequency_last_week,
        avg(rpe) over w as avg_rpe_last_week, avg(completion) over w as completion_rate_last_week
      from measured_load window w as (partition by user_id order by date range between interval 6 days preceding and current row)""",
    "assembled": f"select d.*, {_REPORT}, {_PROFILE} from trained d",
}
_FREQUENCY = """case when training_frequency_last_week >= 3 then {'r': 1, 'o': 2, 'risk': 'high', 'msg':
       'High training frequency detected (' || cast(training_frequency_last_week as varchar) || ' days/week)',
       'act': 'reduce_intensity_or_rest'} end,
    case when fatigue >= 8"""
STATE_ASSESSED = ASSESSED.replace("case when fatigue >= 8", _FREQUENCY).replace("from checked)", "from assembled)")

FIELDS = [
    "days_since_training",
    "training_frequency_last_week",
    "avg_rpe_last_week",
    "completion_rate_last_week",
    "consecutive_high_days",
    *st.REPORTED,
    "primary_goal",
    "current_phase",
]
DAY_MEASURED = "select * exclude (fatigue, soreness, mood, stress), cast(soreness as double) as rpe from states"


def assembled(spark, folder):
    daily = source(spark, folder, "states")
    measured = daily.withColumn("rpe", F.col("soreness").cast("double")).drop("fatigue", "soreness", "mood", "stress")
    return st.daily_state(measured, source(spark, folder, "reports"), source(spark, folder, "profile_changes"))


@query(
    "daily_state",
    f"select user_id, date, {', '.join(FIELDS)}, array_to_string(injury_history, ',') as injuries from assembled",
    "states reports profile_changes",
    "avg_rpe_last_week completion_rate_last_week",
    {"measured": DAY_MEASURED, **STATE},
)
def daily_state(spark, folder):
    """Every field of a state, from measures, reports and profiles as they were known on the day."""
    return assembled(spark, folder).select(*KEYS, *FIELDS, F.array_join("injury_history", ",").alias("injuries"))


@query(
    "daily_state_assess",
    "select user_id, date, is_safe, risk_level, message, recommended_action from assessed",
    "states reports profile_changes",
    extra={"measured": DAY_MEASURED, **STATE, "assessed": STATE_ASSESSED},
)
def daily_state_assess(spark, folder):
    """All checks, that of training frequency included."""
    return sf.assess(st.require_checked(assembled(spark, folder))).select(*KEYS, *sf.OUTCOME)


EXPORT_MEASURED = f"""select user_id, date, round(resting_hr, 6) as resting_hr, round(hrv, 6) as hrv,
  round(active_calories, 6) as active_calories, round(sleep_duration_hours, 2) as sleep_duration_hours,
  cast(null as double) as readiness_score, cast(null as boolean) as overtraining_risk,
  cast(active_calories > 100 as integer) as completion, cast(null as double) as rpe from ({EXPORT_DAILY}) e"""


@query(
    "export_to_recommendation",
    f"""select user_id, date, action_id, workout_type, intensity, duration_minutes, description, is_safe,
        message as safety_message, {RATIONALE} as rationale
        from assessed join greedy using (user_id, date) join actions using (action_id)""",
    "export fb reports profile_changes",
    extra={
        "actions": ACTIONS,
        **POSTERIOR,
        "measured": EXPORT_MEASURED,
        **STATE,
        "assessed": STATE_ASSESSED,
        "open_states": f"select *, {ALLOWED_DECLARED_LOAD} as allowed from assembled",
        "scored_actions": GREEDY["scored_actions"],
        "greedy": GREEDY["greedy"],
    },
)
def export_to_recommendation(spark, folder):
    """From the records of an XML export to a recommendation for every day."""
    daily = health_export_measures(spark, folder)
    measured = daily.select(
        *KEYS,
        *[F.round(c, 6).alias(c) for c in ("resting_hr", "hrv", "active_calories")],
        to_places("sleep_duration_hours", 2).alias("sleep_duration_hours"),
        F.lit(None).cast("double").alias("readiness_score"),
        F.lit(None).cast("boolean").alias("overtraining_risk"),
        (F.col("active_calories") > 100).cast("int").alias("completion"),
        F.lit(None).cast("double").alias("rpe"),
    )
    states = st.daily_state(measured, source(spark, folder, "reports"), source(spark, folder, "profile_changes"))
    posterior = beta(spark, folder)
    return po.recommend(st.require_checked(states), lambda s: po.greedy(s, posterior))
