"""Inputs of the registered queries, derived from the driver's tables.

Each text runs unchanged in Spark and DuckDB; names in braces are tables or other inputs.
``episodes`` alone is built differently in Spark, to number rows without one task per
policy.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators.bounded import dense_index
from pulseframe.session import scratch_path
from pulseframe.sources.files import read_table

TABLES = ("customer", "part", "orders", "lineitem", "events", "conversations")

INPUTS: dict[str, str] = {
    "records": """
select event_id, user_id, ts, cast(ts as date) as date,
  case event_type when 'view' then 'heart_rate' when 'click' then 'steps'
    when 'purchase' then 'active_energy' when 'error' then 'hrv' else 'sleep' end as type,
  case event_type when 'view' then 45 + value / 4 when 'click' then value * 40
    when 'purchase' then value * 8 when 'error' then 15 + value / 2 else 3 + value / 20 end as value,
  value as raw_value, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k
from {events}""",
    "day": """
select user_id, date,
  min(case when type = 'heart_rate' then value end) as resting_hr,
  avg(case when type = 'hrv' then value end) as hrv,
  sum(case when type = 'steps' then value end) as steps,
  sum(case when type = 'active_energy' then value end) as active_calories,
  avg(case when type = 'sleep' then value end) as sleep_duration_hours,
  greatest(0.0e0, 100 - avg(raw_value)) as readiness_score,
  cast(100 - min(k) / 2.0e0 as double) as sleep_score,
  cast(max(k) as double) as activity_score,
  cast(1 + max(k) % 10 as int) as fatigue,
  cast(1 + min(event_id) % 10 as int) as soreness,
  cast(1 + min(k) % 5 as int) as mood,
  cast(1 + max(event_id) % 5 as int) as stress,
  max(k) % 13 = 0 as overtraining_risk,
  case when sum(case when type = 'active_energy' then 1 else 0 end) > 0 then 1
       when sum(case when type = 'steps' then 1 else 0 end) > 0 then 0 end as completion
from {records} group by user_id, date""",
    "states": """
select user_id, date, round(resting_hr, 6) as resting_hr, round(hrv, 6) as hrv, round(steps, 6) as steps,
  round(active_calories, 6) as active_calories, round(sleep_duration_hours, 6) as sleep_duration_hours,
  round(readiness_score, 6) as readiness_score, sleep_score, activity_score, fatigue, soreness, mood, stress,
  overtraining_risk, completion
from {day}""",
    # Two devices that overlap: the watch does not measure hrv; the ring does not count steps but
    # estimates them, and reads pulse and energy a little lower.
    "apple_records": "select * from {records} where type <> 'hrv'",
    "oura_day": """
select user_id, date, greatest(0.0e0, 100 - avg(raw_value)) as readiness_score,
  avg(case when type = 'hrv' then value end) as hrv,
  min(case when type = 'heart_rate' then value end) - 2 as resting_hr,
  sum(case when type = 'active_energy' then value end) * 10 as steps,
  sum(case when type = 'active_energy' then value end) * 0.9e0 as active_calories,
  avg(case when type = 'sleep' then value end) as sleep_duration_hours
from {records} where type <> 'steps' group by user_id, date""",
    "night": """
select user_id, date, avg(value) as sleep_duration_hours, cast(max(k) as double) as sleep_score
from {records} where type = 'sleep' group by user_id, date""",
    "fb": """
select o_custkey as user_id, cast(l_partkey % 18 as int) as action_id, l_orderkey as session_id,
  cast(l_shipdate as date) as date,
  case when l_returnflag <> 'R' then 1.0e0 else 0.0e0 end as completion,
  l_quantity / 50 as adherence_ratio, (l_tax - 0.04e0) * 5 as recovery_change,
  l_discount * 10 as satisfaction, (l_linestatus = 'F' and l_quantity > 40) as overtraining
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "fb_events": """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as event_id, cast(l_orderkey + l_partkey as int) as n,
  o_custkey as user_id, cast(l_partkey % 18 as int) as action_id, cast(l_shipdate as date) as date,
  case when l_returnflag <> 'R' then 1.0e0 else 0.0e0 end as completion,
  l_quantity / 50 as adherence_ratio, (l_tax - 0.04e0) * 5 as recovery_change,
  l_discount * 10 as satisfaction, (l_linestatus = 'F' and l_quantity > 40) as overtraining
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    # Feedback as a transport delivers it in three parts: some messages are broken in one of four
    # ways, some come long after their time, some twice, of these half in the part after.
    "faulty": """
select *, case when n % 11 = 0 then 'unreadable' when n % 13 = 0 then 'wrong type'
    when n % 17 = 0 then 'unknown action' when n % 23 = 0 then 'no event type' end as fault,
  case when n % 19 = 0 then 2 when date < date '1998-01-01' then 0 when date < date '2000-01-01' then 1 else 2 end as part
from {fb_events}""",
    "delivered": """
select *, case when copy = 1 and n % 14 = 0 then least(part + 1, 2) else part end as arrival
from (select f.*, 0 as copy from {faulty} f
      union all select f.*, 1 as copy from {faulty} f where n % 7 = 0 and fault is null) c""",
    "sessions": """
select o_custkey as user_id, o_orderkey as session_id, o_orderdate as date, p_name as exercise_name,
  l_linenumber as position, cast(1 + l_linenumber % 5 as int) as sets, cast(5 + l_suppkey % 10 as int) as reps,
  l_quantity as weight_kg, cast(1 + l_partkey % 10 as int) as rpe, cast(1 + o_orderkey % 10 as int) as fatigue,
  cast(1 + o_custkey % 10 as int) as motivation,
  case when o_orderkey % 7 = 0 then null else cast(1 + o_orderkey % 9 as int) end as muscle_soreness,
  o_orderpriority as workout_type, cast(20 + o_orderkey % 41 as int) as total_duration_minutes
from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey""",
    "profiles": """
select c_custkey as user_id, cast(10 + c_custkey % 95 as int) as age, 25 + abs(c_acctbal) / 30 as weight,
  cast(95 + c_custkey % 160 as double) as height,
  case c_mktsegment when 'MACHINERY' then 'strength' when 'BUILDING' then 'muscle_gain'
    when 'AUTOMOBILE' then 'endurance' when 'HOUSEHOLD' then 'weight_loss' else 'unlisted' end as fitness_goal
from {customer}""",
    "episodes": """
select event_type as policy, row_number() over (partition by event_type order by event_id) - 1 as episode,
  cast(user_id % 18 as int) as action_id,
  cast(cast(regexp_extract(props, '([0-9]+)', 1) as int) % 18 as int) as optimal_action_id,
  least(1.0e0, value / 100) as reward, value > 150 as is_overtraining
from {events}""",
    "decisions": """
select d.*, cast((user_id * 7 + extract(day from date)) % 18 as int) as action_id,
  coalesce(completion, 0) + 0.3e0 * mood / 5 as reward
from {states} d""",
    # One HealthKit record per event: all eight known types and one unknown, some values that
    # are not numbers, and wall-clock times with one of two offsets.
    "export": """
select event_id, user_id, k,
  case event_type
    when 'view' then case when k % 5 = 0 then 'HKQuantityTypeIdentifierRestingHeartRate'
                          else 'HKQuantityTypeIdentifierHeartRate' end
    when 'click' then 'HKQuantityTypeIdentifierStepCount'
    when 'purchase' then case when k % 4 = 0 then 'HKQuantityTypeIdentifierBasalEnergyBurned'
                              else 'HKQuantityTypeIdentifierActiveEnergyBurned' end
    when 'error' then case when k % 10 = 0 then 'HKQuantityTypeIdentifierBodyMass'
                           else 'HKQuantityTypeIdentifierHeartRateVariabilitySDNN' end
    else case when k % 3 = 0 then 'HKWorkoutTypeIdentifier'
              else 'HKCategoryTypeIdentifierSleepAnalysis' end end as hk_type,
  case event_type
    when 'view' then case when k % 5 = 0 then 'resting_heart_rate' else 'heart_rate' end
    when 'click' then 'steps'
    when 'purchase' then case when k % 4 = 0 then 'basal_energy' else 'active_energy' end
    when 'error' then case when k % 10 = 0 then 'HKQuantityTypeIdentifierBodyMass' else 'hrv' end
    else case when k % 3 = 0 then 'workout' else 'sleep' end end as type,
  case when k % 17 = 0 then 'n/a' else cast(value as string) end as value_text,
  case when k % 17 = 0 then null else value end as number,
  ts as start_ts, ts + interval '1' second * cast(floor(value * 60) as int) as end_ts,
  case when event_id % 2 = 0 then ts - interval '5' hour else ts end as start_local,
  case when event_id % 2 = 0 then ts + interval '1' second * cast(floor(value * 60) as int) - interval '5' hour
       else ts + interval '1' second * cast(floor(value * 60) as int) end as end_local,
  case when event_id % 2 = 0 then ' -0500' else ' +0000' end as zone,
  concat('watch-', cast(user_id as string)) as source
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from {events}) e""",
    # What users report, some fields of it, and what their profile changes to; several times a day at most.
    "reports": """
select user_id, cast(ts as date) as date, case when k % 3 <> 0 then cast(1 + k % 10 as int) end as fatigue,
  cast(1 + event_id % 10 as int) as motivation, case when k % 4 <> 1 then cast(1 + (k * 3) % 10 as int) end as soreness,
  cast(1 + k % 5 as int) as stress, case when event_id % 2 = 0 then cast(1 + event_id % 5 as int) end as mood
from {records} where type = 'hrv'""",
    "profile_changes": """
select user_id, cast(ts as date) as date, case k % 4 when 0 then 'strength' when 1 then 'endurance' when 2 then 'fat_loss' end as primary_goal,
  case when k % 2 = 0 then 'bulking' else 'cutting' end as current_phase,
  case k % 3 when 0 then split('knee', ',') when 1 then split('back,knee', ',') end as injury_history
from {records} where type = 'active_energy' and k % 5 = 0""",
    "form_feedback": """
select conv_id as user_id, turn, text as comment, cast(length(text) % 350 as int) - 10 as actual_duration,
  case when turn % 5 = 0 then null else turn % 2 = 1 end as thumbs_up,
  case role when 'user' then 'Rest Day' when 'assistant' then 'Cardio (HIIT)' else role end as actual_workout
from {conversations}""",
    "plans": """
select session_id, user_id, position, exercise_name, fatigue,
  case user_id % 3 when 0 then 'low' when 1 then 'moderate' else 'high' end as intensity,
  user_id % 4 as injury_case
from {sessions}""",
}


_numbered_logs: dict[tuple[str, str], str] = {}


def _names(sql: str) -> list[str]:
    known = [*TABLES, *INPUTS]
    return [n for n in known if "{" + n + "}" in sql]


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table or derived input by name."""
    if name in TABLES:
        return read_table(spark, folder, name)
    if name == "episodes":
        # Numbered once and kept, as every query reads the log several times.
        key = (spark.sparkContext.applicationId, folder)
        if key not in _numbered_logs:
            path = scratch_path(spark, "episodes")
            _episodes(source(spark, folder, "events")).write.parquet(path)
            _numbered_logs[key] = path
        return spark.read.parquet(_numbered_logs[key])
    sql = INPUTS[name]
    return spark.sql(sql, **{n: source(spark, folder, n) for n in _names(sql)})


def _episodes(events: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    logged = events.select(
        F.col("event_type").alias("policy"),
        "event_id",
        (F.col("user_id") % 18).cast("int").alias("action_id"),
        (k % 18).alias("optimal_action_id"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("reward"),
        (F.col("value") > 150).alias("is_overtraining"),
    )
    return dense_index(logged, "policy", "event_id", "episode").drop("event_id")


@cache
def _needed(name: str) -> tuple[str, ...]:
    """Inputs that ``name`` builds on, in build order, itself last."""
    found: list[str] = []
    for n in _names(INPUTS[name]):
        if n in INPUTS:
            found += [x for x in _needed(n) if x not in found]
    return (*found, name)


def with_inputs(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text: the inputs as common table expressions, then ``sql``."""
    order: list[str] = []
    for name in names:
        order += [n for n in _needed(name) if n not in order]
    texts = {n: INPUTS[n].format(**{x: x for x in _names(INPUTS[n])}) for n in order}
    texts.update(extra or {})
    if not texts:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in texts.items()) + "\n" + sql
