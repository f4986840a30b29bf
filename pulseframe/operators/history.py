"""Training-log and dashboard summaries."""

from __future__ import annotations

import datetime as dt
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.scalars import pearson

# Metrics of the correlation view, in its order.
CORRELATED = ("readiness", "sleep", "hrv", "fatigue", "activity")

# Flat history column, state field and default.
STATE_COLUMNS = (
    ("readiness", "readiness_score", 0),
    ("sleep", "sleep_score", 0),
    ("hrv", "hrv", 0),
    ("rhr", "resting_hr", 0),
    ("fatigue", "fatigue", 0),
    ("activity", "activity_score", 0),
    ("mood", "mood", 5),
    ("stress", "stress", 5),
)


def nest_history(decisions: DataFrame) -> DataFrame:
    """Decorated decisions as history documents: timestamp, state and recommendation."""
    state = F.struct(*[F.col(field) for _, field, _ in STATE_COLUMNS])
    plan = F.struct("workout_type", "intensity", "duration_minutes")
    return decisions.select("user_id", "timestamp", state.alias("state"), plan.alias("recommendation"))


def _struct_fields(df: DataFrame, name: str) -> list[str]:
    return df.schema[name].dataType.names if name in df.columns else []


def flatten_history(history: DataFrame) -> DataFrame:
    """History documents to the 12-column view with its defaults, plus user and date.

    Plan fields come from the recommendation, then from the top level of the document.
    """
    columns = history.columns
    inner = {name: _struct_fields(history, name) for name in ("state", "recommendation")}

    def plan(field: str, default: object) -> Column:
        found = [F.col(f"recommendation.{field}")] if field in inner["recommendation"] else []
        found += [F.col(field)] if field in columns else []
        return F.coalesce(*found, F.lit(default))

    def metric(field: str, default: int) -> Column:
        found = [F.col(f"state.{field}").cast("double")] if field in inner["state"] else []
        return F.coalesce(*found, F.lit(float(default)))

    return history.select(
        "user_id",
        "timestamp",
        F.date_format("timestamp", "yyyy-MM-dd").alias("date_str"),
        plan("workout_type", "Unknown").alias("workout"),
        plan("intensity", "N/A").alias("intensity"),
        plan("duration_minutes", 0).cast("int").alias("duration"),
        *[metric(field, default).alias(name) for name, field, default in STATE_COLUMNS],
    )


def on_date(history: DataFrame, day: dt.date, ts: str = "timestamp") -> DataFrame:
    return history.where(F.to_date(ts) == F.lit(day))


def since(log: DataFrame, as_of: dt.datetime, days: int, ts: str = "date") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``."""
    return log.where(F.col(ts) >= F.lit(as_of - dt.timedelta(days=days)))


def last_n(history: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` records of each user; the limit is applied before the shuffle too."""
    newest_first = Window.partitionBy("user_id").orderBy(*[F.desc(c) for c in order])
    ranked = history.withColumn("recency", F.row_number().over(newest_first))
    return ranked.where(F.col("recency") <= n)


def last7_summary(flat: DataFrame) -> DataFrame:
    """Means of the last seven records, the latest value's distance from them, and total duration."""
    recent = last_n(flat, 7, ["timestamp"])
    latest = lambda name: F.max(F.when(F.col("recency") == 1, F.col(name)))
    delta = lambda name: F.when(F.count(F.lit(1)) > 1, latest(name) - F.avg(name))
    shown = ("readiness", "hrv", "sleep")
    return recent.groupBy("user_id").agg(
        *[F.avg(name).alias(f"avg_{name}") for name in shown],
        *[delta(name).alias(f"delta_{name}") for name in shown],
        F.sum("duration").alias("total_duration"),
        latest("duration").alias("latest_duration"),
    )


def metric_correlations(flat: DataFrame) -> DataFrame:
    """Correlation of every metric pair per user, one row per pair."""
    pairs = list(combinations(CORRELATED, 2))
    wide = flat.groupBy("user_id").agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot("user_id", [f"{a}|{b}" for a, b in pairs], "pair", "r")
    side = lambda i: F.element_at(F.split("pair", r"\|"), i)
    return long.select("user_id", side(1).alias("metric_a"), side(2).alias("metric_b"), "r")


def strongest_correlation(correlations: DataFrame) -> DataFrame:
    """The pair with the largest signed correlation per user; ties go by metric names."""
    best = F.min(F.struct((-F.col("r")).alias("cost"), "metric_a", "metric_b"))
    found = correlations.where(F.col("r").isNotNull()).groupBy("user_id").agg(best.alias("b"))
    return found.select("user_id", "b.metric_a", "b.metric_b", (-F.col("b.cost")).alias("r"))


def weekly_volume(flat: DataFrame) -> DataFrame:
    """Minutes per user and week starting Monday."""
    week = F.to_date(F.date_trunc("week", "timestamp")).alias("week_start")
    return flat.groupBy("user_id", week).agg(F.sum("duration").alias("minutes"))


def mood_trend(states: DataFrame) -> DataFrame:
    """Mean mood per user (missing counts as 3), whether training should be lighter, and trained days."""
    average = F.avg(F.coalesce("mood", F.lit(3)))
    return states.groupBy("user_id").agg(
        average.alias("avg_mood"),
        (average < 3).alias("suggest_lighter"),
        F.count(F.when(F.col("completion") == 1, 1)).alias("completed_days"),
    )


def session_summary(log: DataFrame, session_time: str = "date") -> DataFrame:
    """Sessions (distinct times), exercises and mean self-reports per user."""
    return log.groupBy("user_id").agg(
        F.countDistinct(session_time).alias("total_sessions"),
        F.count(F.lit(1)).alias("total_exercises"),
        F.avg("fatigue").alias("avg_fatigue"),
        F.avg("motivation").alias("avg_motivation"),
        F.avg("muscle_soreness").alias("avg_muscle_soreness"),
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value of a column per user."""
    counts = df.groupBy("user_id", column).agg(F.count(F.lit(1)).alias("row_count"))
    total = F.sum("row_count").over(Window.partitionBy("user_id"))
    return counts.withColumn("share", F.col("row_count") / total)


def top_exercises(log: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent exercises per user; ties go by name."""
    counts = log.groupBy("user_id", "exercise_name").agg(F.count(F.lit(1)).alias("row_count"))
    order = Window.partitionBy("user_id").orderBy(F.desc("row_count"), "exercise_name")
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
