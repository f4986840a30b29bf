"""DuckDB text shared by several oracles. Each constant is the body of a common table expression
unless noted; the inputs of ``inputs.py`` are assumed to precede it."""

from __future__ import annotations

ACTIONS = """
select action_id, workout_type, intensity, duration_minutes, description,
  case intensity when 'NONE' then 0 when 'LOW' then 1 when 'MEDIUM' then 2 else 3 end as intensity_rank
from (values
  (0, 'REST', 'NONE', 0, 'Rest day - no training'),
  (1, 'RECOVERY', 'LOW', 20, 'Recovery session - 20 minutes'),
  (2, 'RECOVERY', 'LOW', 30, 'Recovery session - 30 minutes'),
  (3, 'STRENGTH', 'LOW', 30, 'Strength training - LOW intensity, 30 min'),
  (4, 'STRENGTH', 'LOW', 45, 'Strength training - LOW intensity, 45 min'),
  (5, 'STRENGTH', 'MEDIUM', 30, 'Strength training - MEDIUM intensity, 30 min'),
  (6, 'STRENGTH', 'MEDIUM', 45, 'Strength training - MEDIUM intensity, 45 min'),
  (7, 'STRENGTH', 'HIGH', 30, 'Strength training - HIGH intensity, 30 min'),
  (8, 'STRENGTH', 'HIGH', 45, 'Strength training - HIGH intensity, 45 min'),
  (9, 'CARDIO', 'LOW', 20, 'Cardio - LOW intensity, 20 min'),
  (10, 'CARDIO', 'LOW', 30, 'Cardio - LOW intensity, 30 min'),
  (11, 'CARDIO', 'LOW', 45, 'Cardio - LOW intensity, 45 min'),
  (12, 'CARDIO', 'MEDIUM', 20, 'Cardio - MEDIUM intensity, 20 min'),
  (13, 'CARDIO', 'MEDIUM', 30, 'Cardio - MEDIUM intensity, 30 min'),
  (14, 'CARDIO', 'MEDIUM', 45, 'Cardio - MEDIUM intensity, 45 min'),
  (15, 'CARDIO', 'HIGH', 20, 'Cardio - HIGH intensity, 20 min'),
  (16, 'CARDIO', 'HIGH', 30, 'Cardio - HIGH intensity, 30 min'),
  (17, 'CARDIO', 'HIGH', 45, 'Cardio - HIGH intensity, 45 min')
) t(action_id, workout_type, intensity, duration_minutes, description)"""

# Two expressions: feedback with its reward, and the Beta posterior. Needs fb and actions.
SCORED = """
select *, completion + 0.5e0 * adherence_ratio - recovery_change + 0.3e0 * satisfaction
  - case when overtraining then 2e0 else 0e0 end as reward from fb"""
POSTERIOR = {
    "scored": SCORED,
    "posterior": """
select a.action_id, 1e0 + count(*) filter (s.reward > 0.5) as alpha,
  1e0 + count(s.action_id) - count(*) filter (s.reward > 0.5) as beta,
  count(s.action_id) as action_count, coalesce(sum(s.reward), 0e0) as total_reward
from actions a left join scored s on a.action_id = s.action_id group by a.action_id""",
}

# Needs decisions and actions.
HISTORY = """
select d.user_id, cast(d.date as timestamp) + interval 12 hour as timestamp,
  strftime(d.date, '%Y-%m-%d') as date_str, a.workout_type as workout, a.intensity,
  a.duration_minutes as duration, coalesce(readiness_score, 0e0) as readiness, readiness_score as readiness_score,
  coalesce(sleep_score, 0e0) as sleep, coalesce(hrv, 0e0) as hrv0, hrv as hrv_raw,
  coalesce(resting_hr, 0e0) as rhr, cast(coalesce(fatigue, 0) as double) as fatigue,
  coalesce(activity_score, 0e0) as activity, cast(coalesce(mood, 5) as double) as mood,
  cast(coalesce(stress, 5) as double) as stress
from decisions d join actions a on a.action_id = d.action_id"""

# A whole query over day: the feature table.
W = "over (partition by user_id order by date rows between {n} preceding and current row)"


def w(n: int) -> str:
    return W.format(n=n - 1)


def slope(c: str) -> str:
    return (
        f"case when {c} is null then null when rn = 1 then 0e0 when rn = 2 then {c} - {c}_1 "
        f"when {c}_1 is not null then ({c} - {c}_2) / 2 end"
    )


NUMBERED = """
(select *, row_number() over o as rn, lag(hrv, 1) over o as hrv_1, lag(hrv, 2) over o as hrv_2,
   lag(readiness_score, 1) over o as readiness_score_1, lag(readiness_score, 2) over o as readiness_score_2,
   median(resting_hr) over (partition by user_id) as rhr_median
 from day window o as (partition by user_id order by date)) n"""

STREAK = """cast(case when completion = 1 then rn - coalesce(max(case when completion is distinct from 1 then rn end)
  over (partition by user_id order by date rows unbounded preceding), 0) else 0 end as integer)"""
SINCE = """cast(rn - coalesce(max(case when completion = 1 then rn end)
  over (partition by user_id order by date rows unbounded preceding), 1) as integer)"""

FEATURE_EXPRESSIONS = {
    "hrv_7d_mean": f"avg(hrv) {w(7)}",
    "hrv_7d_zscore": f"(hrv - avg(hrv) {w(7)}) / (stddev_samp(hrv) {w(7)} + 1e-6)",
    "hrv_trend": slope("hrv"),
    "rhr_deviation": "resting_hr - rhr_median",
    "rhr_7d_mean": f"avg(resting_hr) {w(7)}",
    "sleep_debt": f"""case when avg(sleep_duration_hours) {w(3)} is not null
        then greatest(0e0, 8 - avg(sleep_duration_hours) {w(3)}) end""",
    "sleep_7d_mean": f"avg(sleep_duration_hours) {w(7)}",
    "readiness_7d_mean": f"avg(readiness_score) {w(7)}",
    "readiness_trend": slope("readiness_score"),
    "steps_7d_sum": f"sum(steps) {w(7)}",
    "steps_7d_mean": f"avg(steps) {w(7)}",
    "calories_7d_sum": f"sum(active_calories) {w(7)}",
    "calories_3d_sum": f"sum(active_calories) {w(3)}",
    "activity_7d_mean": f"avg(activity_score) {w(7)}",
    "acwr": f"avg(active_calories) {w(3)} / (avg(active_calories) {w(7)} + 1e-6)",
    "completion_7d_rate": f"avg(completion) {w(7)}",
    "streak": STREAK,
    "days_since_training": SINCE,
    "day_of_week": "cast(isodow(date) - 1 as integer)",
    "is_weekend": "cast(isodow(date) >= 6 as integer)",
    "day_of_month": "cast(day(date) as integer)",
    "month": "cast(month(date) as integer)",
    "hrv_missing": "cast(hrv is null as integer)",
    "resting_hr_missing": "cast(resting_hr is null as integer)",
    "sleep_duration_hours_missing": "cast(sleep_duration_hours is null as integer)",
    "readiness_score_missing": "cast(readiness_score is null as integer)",
    "steps_missing": "cast(steps is null as integer)",
}
BASE_COLUMNS = (
    "user_id date resting_hr hrv steps active_calories sleep_duration_hours readiness_score sleep_score "
    "activity_score fatigue soreness mood stress overtraining_risk completion"
).split()


def features(names: list[str], keep: list[str] | None = None) -> str:
    """A query over day with the named features."""
    kept = keep if keep is not None else ["user_id", "date"]
    columns = [*kept, *[f"{FEATURE_EXPRESSIONS[n]} as {n}" for n in names]]
    return f"select {', '.join(columns)} from {NUMBERED}"


FEATURE_SQL = features(list(FEATURE_EXPRESSIONS), BASE_COLUMNS)
FEATURE_DOUBLES = (
    "resting_hr hrv steps active_calories sleep_duration_hours readiness_score sleep_score activity_score "
    "hrv_7d_mean hrv_7d_zscore hrv_trend rhr_deviation rhr_7d_mean sleep_debt sleep_7d_mean readiness_7d_mean "
    "readiness_trend steps_7d_sum steps_7d_mean calories_7d_sum calories_3d_sum activity_7d_mean acwr "
    "completion_7d_rate"
)

# states with days_since_training. Needs states.
SINCE_STATES = f"""
select * exclude (rn), {SINCE} as days_since_training
from (select *, row_number() over (partition by user_id order by date) as rn from states) n"""

# states with the run of high-load days that ends on each row. Needs states.
LOAD_STATES = """
select * exclude (start_day, high, prev_high, prev_date),
  cast(case when high then date_diff('day', start_day, date) + 1 else 0 end as integer) as consecutive_high_days, case when high then start_day end as high_load_start
from (select *, max(case when high and not coalesce(prev_high and prev_date = date - 1, false) then date end)
        over (partition by user_id order by date rows unbounded preceding) as start_day
      from (select *, lag(high) over o as prev_high, lag(date) over o as prev_date
            from (select *, coalesce(active_calories > 400, false) as high from states) h
            window o as (partition by user_id order by date)) l) s"""

# The failing checks of each state in order of severity; needs a relation named checked.
ASSESSED = """
select c.* exclude (f), coalesce(f.o, 9) = 9 as is_safe, coalesce(f.risk, 'low') as risk_level,
  coalesce(f.msg, 'All safety checks passed') as message, coalesce(f.act, 'proceed_with_plan') as recommended_action
from (select *, list_min([
    case when coalesce(resting_hr > 100, false) or coalesce(hrv < 20 and hrv <> 0, false) then
      {'r': 1, 'o': 0, 'risk': 'high', 'msg': 'Abnormal physiological signals detected: ' || concat_ws('; ',
        case when resting_hr > 100 then 'Resting heart rate elevated (' || cast(resting_hr as varchar) || ' bpm)' end,
        case when hrv < 20 and hrv <> 0 then 'HRV very low (' || cast(hrv as varchar) || ' ms)' end),
       'act': 'rest_day_or_light_activity'} end,
    case when overtraining_risk then {'r': 0, 'o': 1, 'risk': 'critical', 'msg':
       'Overtraining risk detected. Multiple indicators suggest excessive training load.', 'act': 'mandatory_rest_day'} end,
    case when fatigue >= 8 then {'r': 1, 'o': 3, 'risk': 'high', 'msg': 'High fatigue level (' || cast(fatigue as varchar)
       || '/10). Training may be counterproductive.', 'act': 'rest_day_or_recovery_session'} end,
    case when sleep_duration_hours < 4 and sleep_duration_hours <> 0 then {'r': 2, 'o': 4, 'risk': 'medium', 'msg':
       'Insufficient sleep (' || cast(sleep_duration_hours as varchar) || ' hours). Recovery may be compromised.',
       'act': 'light_training_or_rest'} end,
    case when readiness_score < 50 and readiness_score <> 0 then {'r': 2, 'o': 5, 'risk': 'medium', 'msg':
       'Low readiness score (' || cast(readiness_score as varchar) || '/100). Consider lighter training.',
       'act': 'reduce_intensity'} end,
    case when soreness >= 8 then {'r': 1, 'o': 6, 'risk': 'high', 'msg': 'High muscle soreness (' ||
       cast(soreness as varchar) || '/10). Risk of injury if training intensively.', 'act': 'active_recovery_or_rest'} end
   ]) as f from checked) c"""

LOW3, MEDIUM, LOW8, ALL = (
    "[0, 1, 2]",
    "[0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13, 14]",
    "[0, 1, 2, 3, 4, 9, 10, 11]",
    "[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17]",
)

ALLOWED_CODED = f"""case recommended_action when 'mandatory_rest_day' then [0]
  when 'rest_day_or_light_activity' then {LOW3} when 'reduce_intensity' then {MEDIUM} else {ALL} end"""
_REST_OR_RECOVERY = """resting_hr > 100 or (hrv < 20 and hrv <> 0)
  or (sleep_duration_hours < 4 and sleep_duration_hours <> 0) or fatigue >= 8 or soreness >= 8"""
_LOW_READINESS = "readiness_score < 50 and readiness_score <> 0"
ALLOWED_DECLARED_LOAD = f"""case when overtraining_risk then [0] when {_REST_OR_RECOVERY} then {LOW3}
  when ({_LOW_READINESS}) or consecutive_high_days >= 3 then {MEDIUM} else {ALL} end"""
ALLOWED_MINIMAL = f"""case when coalesce(readiness_score, 50) < 30 or coalesce(fatigue, 5) > 8 then {LOW3}
  when coalesce(fatigue, 5) > 6 then {LOW8} else {ALL} end"""

RULE = """case when coalesce(readiness_score, 50) < 40 or coalesce(sleep_duration_hours, 7) < 5 then 0
  else coalesce(
    case when coalesce(fatigue, 5) >= 7 then list_min(list_intersect(allowed, [1, 2])) end,
    case when coalesce(days_since_training, 1) >= 3 then list_min(list_intersect(allowed, [5, 6, 12, 13, 14])) end,
    list_min(list_intersect(allowed, [1, 2, 3, 4, 9, 10, 11])), list_min(allowed), 0) end"""

RATIONALE = """case when workout_type = 'REST' then 'Rest day recommended due to low readiness (' ||
    cast(coalesce(readiness_score, 50e0) as varchar) || ') or insufficient sleep (' ||
    printf('%.1f', coalesce(sleep_duration_hours, 7e0)) || 'h)'
  when intensity = 'LOW' then 'Low intensity ' || lower(workout_type) || ' recommended based on current recovery state'
  else intensity || ' intensity ' || lower(workout_type) || ' recommended - you''re well recovered' end"""
