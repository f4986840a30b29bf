"""Rolling features over a user's daily rows.

All windows share one partitioning (user_id) and one order (date), so the table is
shuffled and sorted once however many features are taken. A partition holds one row per
calendar day, which bounds it for any user. Frames count rows, not days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulseframe.functions.scalars import optional

EPSILON = 1e-6
SLEEP_NEED_HOURS = 8
HIGH_LOAD_CALORIES = 400.0

# The output columns of the feature table by group.
RECOVERY = (
    "hrv",
    "hrv_7d_mean",
    "hrv_7d_zscore",
    "hrv_trend",
    "resting_hr",
    "rhr_deviation",
    "rhr_7d_mean",
    "sleep_duration_hours",
    "sleep_debt",
    "sleep_7d_mean",
    "readiness_score",
    "readiness_7d_mean",
    "readiness_trend",
)
LOAD = (
    "steps",
    "steps_7d_sum",
    "steps_7d_mean",
    "active_calories",
    "calories_7d_sum",
    "calories_3d_sum",
    "activity_score",
    "activity_7d_mean",
    "acwr",
)
CONSISTENCY = (
    "completion_7d_rate",
    "streak",
    "days_since_training",
)
CALENDAR = (
    "day_of_week",
    "is_weekend",
    "day_of_month",
    "month",
)
FLAGGED = (
    "hrv",
    "resting_hr",
    "sleep_duration_hours",
    "readiness_score",
    "steps",
)
FEATURES = [*RECOVERY, *LOAD, *CONSISTENCY, *CALENDAR, *[f"{c}_missing" for c in FLAGGED]]

# The daily metrics that features are made of.
METRICS = (
    "hrv",
    "resting_hr",
    "sleep_duration_hours",
    "readiness_score",
    "steps",
    "active_calories",
    "activity_score",
)


def by_user() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("date")


def running() -> WindowSpec:
    return by_user().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_rows(n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return by_user().rowsBetween(-(n - 1), Window.currentRow)


def mean_of_last(name: str, n: int) -> Column:
    return F.avg(name).over(last_rows(n))


def sum_of_last(name: str, n: int) -> Column:
    return F.sum(name).over(last_rows(n))


def zscore(name: str, n: int = 7) -> Column:
    """Distance from the rolling mean in rolling sample deviations."""
    return (F.col(name) - mean_of_last(name, n)) / (F.stddev_samp(name).over(last_rows(n)) + EPSILON)


def slope_of_last_three(name: str) -> Column:
    """Least-squares slope over the last three rows; with equal spacing only the ends matter.

    0 on the first row, and NULL as soon as one value in the frame is missing.
    """
    x, back1, back2 = F.col(name), F.lag(name, 1).over(by_user()), F.lag(name, 2).over(by_user())
    row = F.row_number().over(by_user())
    return (
        F.when(x.isNull(), None)
        .when(row == 1, F.lit(0.0))
        .when(row == 2, x - back1)
        .when(back1.isNotNull(), (x - back2) / 2)
    )


def sleep_debt(name: str = "sleep_duration_hours") -> Column:
    """Hours short of the nightly need on average over three rows; NULL when none was measured."""
    rested = mean_of_last(name, 3)
    return F.when(rested.isNotNull(), F.greatest(F.lit(0.0), SLEEP_NEED_HOURS - rested))


def acute_chronic_ratio(name: str = "active_calories") -> Column:
    return mean_of_last(name, 3) / (mean_of_last(name, 7) + EPSILON)


def deviation_from_median(name: str) -> Column:
    """Distance from the median of the user's whole history."""
    return F.col(name) - F.median(name).over(Window.partitionBy("user_id"))


def streak(done: Column) -> Column:
    """Length of the run of ``done`` rows that ends here. Needs ``_row`` = row_number over by_user."""
    last_break = F.max(F.when(~done, F.col("_row"))).over(running())
    return F.when(done, F.col("_row") - F.coalesce(last_break, F.lit(0))).otherwise(0)


def rows_since(done: Column) -> Column:
    """Rows since the last ``done`` row, counted from the first row before any. Needs ``_row``."""
    last_done = F.max(F.when(done, F.col("_row"))).over(running())
    return F.col("_row") - F.coalesce(last_done, F.lit(1))


def numbered(daily: DataFrame) -> DataFrame:
    return daily.withColumn("_row", F.row_number().over(by_user()))


def completed(name: str = "completion") -> Column:
    return F.col(name).eqNullSafe(F.lit(1))


def calendar_columns(date: str = "date") -> dict[str, Column]:
    """Weekday (Monday = 0), weekend flag, day of month and month."""
    weekday = F.weekday(date)
    return {
        "day_of_week": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
        "day_of_month": F.dayofmonth(date),
        "month": F.month(date),
    }


def missing_columns() -> dict[str, Column]:
    return {f"{name}_missing": F.col(name).isNull().cast("int") for name in FLAGGED}


def with_all_metrics(daily: DataFrame) -> DataFrame:
    """Add measures the input lacks as NULL so that the output schema never varies."""
    have = daily.columns
    absent = {name: optional(have, name, "double") for name in [*METRICS, "completion"] if name not in have}
    return daily.withColumns(absent) if absent else daily


def daily_features(daily: DataFrame) -> DataFrame:
    """The full feature table of a unified daily table."""
    base = with_all_metrics(daily)
    done = completed()
    features = {
        "hrv_7d_mean": mean_of_last("hrv", 7),
        "hrv_7d_zscore": zscore("hrv"),
        "hrv_trend": slope_of_last_three("hrv"),
        "rhr_deviation": deviation_from_median("resting_hr"),
        "rhr_7d_mean": mean_of_last("resting_hr", 7),
        "sleep_debt": sleep_debt(),
        "sleep_7d_mean": mean_of_last("sleep_duration_hours", 7),
        "readiness_7d_mean": mean_of_last("readiness_score", 7),
        "readiness_trend": slope_of_last_three("readiness_score"),
        "steps_7d_sum": sum_of_last("steps", 7),
        "steps_7d_mean": mean_of_last("steps", 7),
        "calories_7d_sum": sum_of_last("active_calories", 7),
        "calories_3d_sum": sum_of_last("active_calories", 3),
        "activity_7d_mean": mean_of_last("activity_score", 7),
        "acwr": acute_chronic_ratio(),
        "completion_7d_rate": mean_of_last("completion", 7),
        "streak": streak(done),
        "days_since_training": rows_since(done),
        **calendar_columns(),
        **missing_columns(),
    }
    kept = [name for name in base.columns if name not in features]
    ordered = ["user_id", "date", "completion", *FEATURES]
    extra = [name for name in kept if name not in ordered]
    return numbered(base).withColumns(features).select(*ordered, *extra)


def with_days_since_training(daily: DataFrame) -> DataFrame:
    """Add rows since the last completed training."""
    return numbered(daily).withColumn("days_since_training", rows_since(completed())).drop("_row")


def with_high_load_days(daily: DataFrame, threshold: float = HIGH_LOAD_CALORIES) -> DataFrame:
    """Add the length in calendar days of the run of high-load days that ends on each row.

    ``high_load_start`` is the first day of that run. A missing day ends a run.
    """
    high = F.coalesce(F.col("active_calories") > threshold, F.lit(False))
    number = F.unix_date("date")
    base = daily.withColumns({"_high": high, "_day": number})
    follows = F.lag("_high").over(by_user()) & (F.lag("_day").over(by_user()) == F.col("_day") - 1)
    starts = F.col("_high") & ~F.coalesce(follows, F.lit(False))
    run = base.withColumn("_start", F.when(starts, F.col("_day")))
    start = F.max("_start").over(running())
    return run.withColumns(
        {
            "high_load_start": F.when(F.col("_high"), F.date_from_unix_date(start)),
            "consecutive_high_days": F.when(F.col("_high"), F.col("_day") - start + 1).otherwise(0),
        }
    ).drop("_high", "_day", "_start")


def high_load_runs(daily: DataFrame, threshold: float = HIGH_LOAD_CALORIES, min_days: int = 3) -> DataFrame:
    """Runs of at least ``min_days`` consecutive high-load calendar days."""
    return (
        with_high_load_days(daily, threshold)
        .where(F.col("high_load_start").isNotNull())
        .groupBy("user_id", F.col("high_load_start").alias("start_date"))
        .agg(F.max("date").alias("end_date"), F.max("consecutive_high_days").alias("days"))
        .where(F.col("days") >= min_days)
    )


def last_week_training(daily: DataFrame, rpe: str = "rpe") -> DataFrame:
    """Training days, mean exertion and completion rate over the last seven calendar days."""
    week = Window.partitionBy("user_id").orderBy(F.unix_date("date")).rangeBetween(-6, 0)
    return daily.withColumns(
        {
            "training_frequency_last_week": F.sum(completed().cast("int")).over(week),
            "avg_rpe_last_week": F.avg(rpe).over(week),
            "completion_rate_last_week": F.avg("completion").over(week),
        }
    )
