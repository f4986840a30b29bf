"""Oura trend files and landed API payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.scalars import to_number, wall_clock_date
from pulseframe.sources.files import read_csv_by_name

# Headers of the trends file and their canonical names.
TREND_COLUMNS = {
    "Readiness Score": "readiness_score",
    "Sleep Score": "sleep_score",
    "Activity Score": "activity_score",
    "Average HRV": "hrv",
    "Average Resting Heart Rate": "resting_hr",
    "Total Sleep Duration": "sleep_duration_hours",
    "Steps": "steps",
    "Total Burn": "total_calories",
    "Activity Burn": "active_calories",
}

# Per payload kind, the source field, its type and the output name.
PAYLOADS = {
    "sleep": (
        ("day", "string", "date"),
        ("score", "double", "sleep_score"),
        ("total_sleep_duration", "double", "total_sleep_duration"),
        ("deep_sleep_duration", "double", "deep_sleep_duration"),
        ("rem_sleep_duration", "double", "rem_sleep_duration"),
        ("light_sleep_duration", "double", "light_sleep_duration"),
        ("efficiency", "double", "sleep_efficiency"),
        ("resting_heart_rate", "double", "resting_heart_rate"),
        ("hrv", "double", "hrv"),
        ("sleep_latency", "double", "sleep_onset_latency"),
        ("awake_time", "double", "awake_time"),
    ),
    "activity": (
        ("day", "string", "date"),
        ("steps", "double", "steps"),
        ("calories_total", "double", "calories_total"),
        ("calories_active", "double", "calories_active"),
        ("score", "double", "activity_score"),
        ("met_minutes", "double", "met_minutes"),
        ("low_activity_time", "double", "low_activity_time"),
        ("medium_activity_time", "double", "medium_activity_time"),
        ("high_activity_time", "double", "high_activity_time"),
    ),
    "readiness": (
        ("day", "string", "date"),
        ("score", "double", "readiness_score"),
        ("temperature_trend", "double", "temperature_trend"),
        ("hrv_balance", "double", "hrv_balance"),
        ("recovery_index", "double", "recovery_index"),
        ("resting_heart_rate", "double", "resting_heart_rate"),
    ),
    "heart_rate": (
        ("timestamp", "string", "timestamp"),
        ("bpm", "double", "bpm"),
        ("source", "string", "source"),
    ),
}


def _one_trends_file(spark: SparkSession, path: str, sleep_divisor: float, keep: tuple[str, ...]) -> DataFrame:
    raw = read_csv_by_name(spark, path)
    known = {h: n for h, n in TREND_COLUMNS.items() if h in raw.columns}
    extra = [F.col(c) for c in keep if c in raw.columns]
    measures = [to_number(F.col(f"`{h}`")).alias(n) for h, n in known.items()]
    trends = raw.select(*extra, wall_clock_date("date").alias("date"), *measures)
    if "sleep_duration_hours" in trends.columns and sleep_divisor != 1:
        trends = trends.withColumn("sleep_duration_hours", F.col("sleep_duration_hours") / sleep_divisor)
    return trends


def scan_oura_trends(
    spark: SparkSession, paths: str | list[str], sleep_divisor: float = 1, keep: tuple[str, ...] = ("user_id",)
) -> DataFrame:
    """Trends files under canonical names; headers a file lacks are left out.

    Files with different headers are aligned by name.
    ``sleep_divisor`` converts the sleep duration to hours (1 leaves it as delivered).
    """
    listed = [paths] if isinstance(paths, str) else paths
    parts = [_one_trends_file(spark, p, sleep_divisor, keep) for p in listed]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_oura_payloads(
    spark: SparkSession, path: str | list[str], kind: str, multi_line: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per entry of landed ``{"data": [...]}`` payloads of one kind.

    Payloads are one per line by default; ``multi_line`` reads one pretty-printed document
    per file. ``keep`` names string fields beside ``data`` to carry along.
    """
    fields = PAYLOADS[kind]
    entry = ", ".join(f"{name}: {data_type}" for name, data_type, _ in fields)
    beside = "".join(f", {name} string" for name in keep)
    schema = f"data array<struct<{entry}>>{beside}"
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    entries = raw.select(*keep, F.explode("data").alias("e"))
    return entries.select(*keep, *[F.col(f"e.{name}").alias(out) for name, _, out in fields])
