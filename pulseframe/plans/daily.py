"""Queries over records, daily rows and their windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators import daily as dy
from pulseframe.operators import features as ft
from pulseframe.operators import quality as ql
from pulseframe.plans.ingest import health_records
from pulseframe.plans.inputs import source
from pulseframe.plans.oracle_parts import FEATURE_DOUBLES, FEATURE_SQL, LOAD_STATES, features
from pulseframe.plans.registry import query
from pulseframe.sources.health_xml import measurable

HR = "('heart_rate', 'resting_heart_rate')"


@query(
    "daily_heart_rate",
    """select user_id, date, avg(value) as hr_mean, min(value) as hr_min, max(value) as hr_max,
       stddev_samp(value) as hr_std, min(value) as resting_hr from records where type = 'heart_rate'
       group by user_id, date""",
    "records",
    "hr_mean hr_min hr_max hr_std resting_hr",
)
def daily_heart_rate(spark, folder):
    return dy.daily_heart_rate(source(spark, folder, "records"))


@query(
    "daily_activity",
    """select user_id, date, sum(case when type = 'steps' then value end) as steps,
       sum(case when type = 'active_energy' then value end) as active_calories,
       cast(null as double) as basal_calories
       from records where type in ('steps', 'active_energy') group by user_id, date""",
    "records",
    "steps active_calories basal_calories",
)
def daily_activity(spark, folder):
    return dy.daily_activity(source(spark, folder, "records"))


@query(
    "daily_sleep",
    "select user_id, date, sum(value) as sleep_duration_hours from records where type = 'sleep' group by user_id, date",
    "records",
    "sleep_duration_hours",
)
def daily_sleep(spark, folder):
    return dy.daily_sleep(source(spark, folder, "records"), "value")


MEASURES = """select user_id, date, avg(case when type = 'heart_rate' then value end) as hr_mean,
  min(case when type = 'heart_rate' then value end) as hr_min,
  max(case when type = 'heart_rate' then value end) as hr_max,
  stddev_samp(case when type = 'heart_rate' then value end) as hr_std,
  sum(case when type = 'steps' then value end) as steps,
  sum(case when type = 'active_energy' then value end) as active_calories,
  cast(null as double) as basal_calories,
  sum(case when type = 'sleep' then value end) as sleep_duration_hours,
  avg(case when type = 'hrv' then value end) as hrv,
  min(case when type = 'heart_rate' then value end) as resting_hr
from {t} group by user_id, date"""
MEASURE_DOUBLES = (
    "hr_mean hr_min hr_max hr_std steps active_calories basal_calories sleep_duration_hours hrv resting_hr"
)


@query("apple_daily", MEASURES.format(t="apple_records"), "apple_records", MEASURE_DOUBLES)
def apple_daily(spark, folder):
    return dy.daily_measures(source(spark, folder, "apple_records"), "value")


EXPORT_DAILY = """select user_id, date, avg(case when h then number end) as hr_mean, min(case when h then number end) as hr_min,
       max(case when h then number end) as hr_max, stddev_samp(case when h then number end) as hr_std,
       case when max(type = 'steps') then coalesce(sum(case when type = 'steps' then number end), 0e0) end as steps,
       case when max(type = 'active_energy') then coalesce(sum(case when type = 'active_energy' then number end), 0e0) end
         as active_calories,
       case when max(type = 'basal_energy') then coalesce(sum(case when type = 'basal_energy' then number end), 0e0) end
         as basal_calories,
       case when max(type = 'sleep') then coalesce(sum(case when type = 'sleep' then hours end), 0e0) end
         as sleep_duration_hours,
       avg(case when type = 'hrv' then number end) as hrv, min(case when h then number end) as resting_hr
       from (select *, cast(start_local as date) as date, type in ('heart_rate', 'resting_heart_rate') as h,
               (floor(epoch(end_ts)) - floor(epoch(start_ts))) / 3600e0 as hours from export
             where type not in ('workout', 'HKQuantityTypeIdentifierBodyMass')) e group by user_id, date"""


def health_export_measures(spark, folder):
    """XML export to daily rows; the user is the number in the source name."""
    records = measurable(health_records(spark, folder))
    user = F.regexp_extract("source", "([0-9]+)", 1).cast("bigint")
    return dy.daily_measures(records.withColumn("user_id", user))


@query("health_export_daily", EXPORT_DAILY, "export", MEASURE_DOUBLES)
def health_export_daily(spark, folder):
    return health_export_measures(spark, folder)


SHARED = "resting_hr hrv steps active_calories sleep_duration_hours".split()


@query(
    "unify_daily",
    f"""select user_id, date, hr_mean, hr_min, hr_max, hr_std, basal_calories, o.readiness_score,
       {', '.join(f'a.{c} as {c}_apple, o.{c} as {c}_oura, coalesce(o.{c}, a.{c}) as {c}' for c in SHARED)}
       from apple a full join oura_day o using (user_id, date)""",
    "apple_records oura_day",
    "hr_mean hr_min hr_max hr_std basal_calories readiness_score "
    + " ".join(f"{c}_apple {c}_oura {c}" for c in SHARED),
    {"apple": MEASURES.format(t="apple_records")},
)
def unify_daily(spark, folder):
    apple = dy.daily_measures(source(spark, folder, "apple_records"), "value")
    return dy.unify({"oura": source(spark, folder, "oura_day"), "apple": apple})


@query(
    "unify_daily_three",
    """select user_id, date, hr_mean, hr_min, hr_max, hr_std, basal_calories, ao.readiness_score, p.sleep_score,
       resting_hr_apple, resting_hr_oura, resting_hr, hrv_apple, hrv_oura, hrv, steps_apple, steps_oura, steps,
       active_calories_apple, active_calories_oura, active_calories,
       sleep_duration_hours_apple, sleep_duration_hours_oura, p.sleep_duration_hours as sleep_duration_hours_pmdata,
       coalesce(sleep_duration_hours_oura, sleep_duration_hours_apple, p.sleep_duration_hours) as sleep_duration_hours
       from (select user_id, date, hr_mean, hr_min, hr_max, hr_std, basal_calories, o.readiness_score,
         a.resting_hr as resting_hr_apple, o.resting_hr as resting_hr_oura, coalesce(o.resting_hr, a.resting_hr) as resting_hr,
         a.hrv as hrv_apple, o.hrv as hrv_oura, coalesce(o.hrv, a.hrv) as hrv,
         a.steps as steps_apple, o.steps as steps_oura, coalesce(o.steps, a.steps) as steps,
         a.active_calories as active_calories_apple, o.active_calories as active_calories_oura,
         coalesce(o.active_calories, a.active_calories) as active_calories,
         a.sleep_duration_hours as sleep_duration_hours_apple, o.sleep_duration_hours as sleep_duration_hours_oura
         from apple a full join oura_day o using (user_id, date)) ao full join night p using (user_id, date)""",
    "apple_records oura_day night",
    "hr_mean hr_min hr_max hr_std basal_calories readiness_score sleep_score sleep_duration_hours_pmdata "
    + " ".join(f"{c}_apple {c}_oura {c}" for c in SHARED),
    {"apple": MEASURES.format(t="apple_records")},
)
def unify_daily_three(spark, folder):
    apple = dy.daily_measures(source(spark, folder, "apple_records"), "value")
    return dy.unify(
        {"oura": source(spark, folder, "oura_day"), "apple": apple, "pmdata": source(spark, folder, "night")}
    )


@query(
    "concat_sources",
    """select user_id, date, 'oura' as source, readiness_score, hrv, cast(null as double) as sleep_score from oura_day
       union all select user_id, date, 'pmdata', null, null, sleep_score from night""",
    "oura_day night",
    "readiness_score hrv sleep_score",
)
def concat_sources(spark, folder):
    return dy.concat_sources(
        {
            "oura": source(spark, folder, "oura_day").select("user_id", "date", "readiness_score", "hrv"),
            "pmdata": source(spark, folder, "night").select("user_id", "date", "sleep_score"),
        }
    )


@query(
    "source_profile",
    """select source, count(*) as row_count, min(date) as first_date, max(date) as last_date from (
         select 'apple' as source, date from apple_records union all select 'oura', date from oura_day
         union all select 'pmdata', date from night) s group by source""",
    "apple_records oura_day night",
)
def source_profile(spark, folder):
    names = {"apple": "apple_records", "oura": "oura_day", "pmdata": "night"}
    return ql.source_profile(dy.concat_sources({k: source(spark, folder, n).select("date") for k, n in names.items()}))


MEANS = {
    "hrv_7d_mean": "hrv",
    "rhr_7d_mean": "resting_hr",
    "sleep_7d_mean": "sleep_duration_hours",
    "readiness_7d_mean": "readiness_score",
    "steps_7d_mean": "steps",
    "activity_7d_mean": "activity_score",
}


def _feature_query(name: str, columns: list[str], build, doubles: bool = True) -> None:
    """A query of some features with the key columns; ``build`` gives the expressions by name."""

    @query(name, features(columns), "day", " ".join(columns) if doubles else "")
    def run(spark, folder):
        expressions = build()
        df = ft.numbered(source(spark, folder, "day"))
        return df.select("user_id", "date", *[expressions[n].alias(n) for n in columns])


_feature_query("rolling_means", list(MEANS), lambda: {n: ft.mean_of_last(c, 7) for n, c in MEANS.items()})
_feature_query("hrv_zscore", ["hrv_7d_zscore"], lambda: {"hrv_7d_zscore": ft.zscore("hrv")})
_feature_query(
    "trend_slopes",
    ["hrv_trend", "readiness_trend"],
    lambda: {
        "hrv_trend": ft.slope_of_last_three("hrv"),
        "readiness_trend": ft.slope_of_last_three("readiness_score"),
    },
)
_feature_query(
    "rolling_sums",
    ["steps_7d_sum", "calories_7d_sum", "calories_3d_sum"],
    lambda: {
        "steps_7d_sum": ft.sum_of_last("steps", 7),
        "calories_7d_sum": ft.sum_of_last("active_calories", 7),
        "calories_3d_sum": ft.sum_of_last("active_calories", 3),
    },
)
_feature_query("sleep_debt", ["sleep_debt"], lambda: {"sleep_debt": ft.sleep_debt()})
_feature_query("acwr", ["acwr"], lambda: {"acwr": ft.acute_chronic_ratio()})
_feature_query("rhr_deviation", ["rhr_deviation"], lambda: {"rhr_deviation": ft.deviation_from_median("resting_hr")})
_feature_query(
    "completion_rate", ["completion_7d_rate"], lambda: {"completion_7d_rate": ft.mean_of_last("completion", 7)}
)
_feature_query("training_streak", ["streak"], lambda: {"streak": ft.streak(ft.completed())}, doubles=False)
_feature_query(
    "days_since_training",
    ["days_since_training"],
    lambda: {"days_since_training": ft.rows_since(ft.completed())},
    doubles=False,
)
_feature_query("temporal_features", ft.CALENDAR, ft.calendar_columns, doubles=False)
_feature_query("missing_flags", [f"{c}_missing" for c in ft.FLAGGED], ft.missing_columns, doubles=False)


@query("daily_features", FEATURE_SQL, "day", FEATURE_DOUBLES)
def daily_features(spark, folder):
    return ft.daily_features(source(spark, folder, "day"))


@query(
    "high_load_runs",
    """select user_id, high_load_start as start_date, max(date) as end_date, max(consecutive_high_days) as days
       from load_states where high_load_start is not null group by user_id, high_load_start
       having max(consecutive_high_days) >= 3""",
    "states",
    extra={"load_states": LOAD_STATES},
)
def high_load_runs(spark, folder):
    return ft.high_load_runs(source(spark, folder, "states"))


@query(
    "last_week_training",
    """select user_id, date, cast(sum(cast(completion is not distinct from 1 as integer)) over w as bigint)
         as training_frequency_last_week,
       avg(soreness) over w as avg_rpe_last_week, avg(completion) over w as completion_rate_last_week
       from day window w as (partition by user_id order by date range between interval 6 days preceding and current row)""",
    "day",
    "avg_rpe_last_week completion_rate_last_week",
)
def last_week_training(spark, folder):
    week = ft.last_week_training(source(spark, folder, "day"), rpe="soreness")
    return week.select(
        "user_id", "date", "training_frequency_last_week", "avg_rpe_last_week", "completion_rate_last_week"
    )


COVERED = "readiness_score sleep_duration_hours steps hrv resting_hr active_calories completion".split()


@query(
    "coverage_report",
    " union all ".join(
        f"select '{c}' as metric, count({c}) as non_null, count({c}) * 100e0 / count(*) as coverage_pct from day"
        for c in COVERED
    ),
    "day",
    "coverage_pct",
)
def coverage_report(spark, folder):
    return ql.coverage(source(spark, folder, "day"), COVERED)


@query(
    "column_means",
    " union all ".join(
        f"select '{c}' as metric, avg({c}) as mean from day"
        for c in "resting_hr hrv steps sleep_duration_hours readiness_score sleep_score activity_score".split()
    ),
    "day",
    "mean",
)
def column_means(spark, folder):
    return ql.column_means(source(spark, folder, "day"), ["readiness", "sleep", "hrv", "_hr", "steps", "score"])


@query(
    "top_record_types",
    """select type, count(*) as row_count from export group by type order by row_count desc, type limit 10""",
    "export",
)
def top_record_types(spark, folder):
    return ql.top_counts(health_records(spark, folder), "type")
