"""The daily state: what is known of a user on a day, put together from tables that change on their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.features import last_week_training, with_days_since_training, with_high_load_days

# What a user reports, and what their profile says.
REPORTED = ("fatigue", "motivation", "soreness", "stress", "mood")
PROFILE = ("primary_goal", "current_phase", "injury_history")

#: Columns that the checks and limits of a state read; null is a value that isn't known.
CHECKED = (
    "resting_hr",
    "hrv",
    "sleep_duration_hours",
    "readiness_score",
    "fatigue",
    "soreness",
    "overtraining_risk",
    "training_frequency_last_week",
    "consecutive_high_days",
)

#: Days after which a report says nothing of today any more.
REPORT_DAYS = 3


def as_of(
    rows: DataFrame, facts: DataFrame, key: str, day: str, fact_day: str, columns: tuple[str, ...], max_days: int | None = None
) -> DataFrame:
    """Add ``columns`` of the last fact of the key that is not after the row's day, without looking ahead.

    A column that a fact leaves null keeps its value from the fact before. Facts older than
    ``max_days`` count as none. Of several facts of a key on a day, they are taken in the order of
    all their columns. Both sides meet in one shuffle by the key and one pass in order of the day:
    no pair of row and fact is made.
    """
    carried = [F.struct(F.col(fact_day).alias("since"), F.col(c).alias("value")).alias(f"_{c}") for c in columns]
    known = [F.when(F.col(c).isNotNull(), s) for c, s in zip(columns, carried)]
    order = F.struct(*[F.col(c) for c in sorted(columns)])
    right = facts.select(
        F.col(key).alias("_key"),
        F.col(fact_day).alias("_day"),
        F.lit(0).alias("_side"),
        order.alias("_order"),
        *[k.alias(f"_{c}") for k, c in zip(known, columns)],
    )
    left = rows.select(F.col(key).alias("_key"), F.col(day).alias("_day"), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    both = right.unionByName(left, allowMissingColumns=True)
    before = Window.partitionBy("_key").orderBy("_day", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"_{c}": F.last(f"_{c}", ignorenulls=True).over(before) for c in columns}
    found = both.withColumns(last).where("_side = 1")

    def value(column: str) -> Column:
        fact = F.col(f"_{column}")
        fresh = F.lit(True) if max_days is None else F.datediff("_day", fact["since"]) <= max_days
        return F.when(fresh, fact["value"]).alias(column)

    return found.select("_row.*", *[value(c) for c in columns])


def daily_state(daily: DataFrame, reports: DataFrame, profiles: DataFrame, rpe: str = "rpe") -> DataFrame:
    """One row per user and day of ``daily``, with every field of a state.

    ``daily`` holds the measures with completion, exertion and overtraining_risk; ``reports`` have
    user_id, date and any of the reported fields; ``profiles`` have user_id, date of change and the
    profile's fields. A day takes what had been reported up to then, at most ``REPORT_DAYS`` ago,
    and the profile as it was. Training history comes from the days before and the day itself.
    """
    trained = last_week_training(with_days_since_training(with_high_load_days(daily)), rpe)
    reported = as_of(trained, reports, "user_id", "date", "date", REPORTED, REPORT_DAYS)
    return as_of(reported, profiles, "user_id", "date", "date", PROFILE)


def require_checked(states: DataFrame) -> DataFrame:
    """The states, if they have every column that a check or limit reads; a limit must not vanish with one."""
    missing = [c for c in CHECKED if c not in states.columns]
    if missing:
        raise ValueError(f"states lack {', '.join(missing)}; where it isn't known it must be null")
    return states
