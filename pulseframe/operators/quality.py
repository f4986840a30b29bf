"""Validation rules, coverage and profile reports, referential checks, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions.scalars import to_places

# Value domains.
WORKOUT_DOMAIN = (
    "Upper Body Strength",
    "Lower Body Strength",
    "Full Body Strength",
    "Cardio (HIIT)",
    "Cardio (Steady State)",
    "Flexibility/Mobility",
    "Rest Day",
    "Active Recovery",
    "Unknown",
)
INTENSITY_DOMAIN = ("low", "moderate", "high", "very_high")
GOAL_DOMAIN = ("strength", "endurance", "weight_loss", "muscle_gain", "general_fitness")
EXPERIENCE_DOMAIN = ("beginner", "intermediate", "advanced")
SOURCE_DOMAIN = ("manual_upload", "csv_upload", "json_upload", "api", "apple_health", "oura_ring")

# Per schema, the required columns, closed ranges, lengths and domains.
SCHEMAS: dict[str, dict] = {
    "body_state": {
        "required": ("readiness_score", "sleep_score", "hrv", "resting_hr", "activity_score", "fatigue"),
        "ranges": {
            "readiness_score": (0, 100),
            "sleep_score": (0, 100),
            "hrv": (10, 150),
            "resting_hr": (40, 100),
            "activity_score": (0, 100),
            "exercise_minutes": (0, 300),
            "fatigue": (1, 10),
            "mood": (1, 10),
            "stress": (1, 10),
            "body_temperature": (35, 42),
            "blood_oxygen": (80, 100),
        },
    },
    "recommendation": {
        "required": ("workout_type", "intensity", "duration_minutes"),
        "ranges": {"duration_minutes": (0, 180), "confidence": (0, 1)},
        "domains": {"workout_type": WORKOUT_DOMAIN, "intensity": INTENSITY_DOMAIN},
    },
    "training_entry": {
        "ranges": {"actual_duration": (0, 300)},
        "domains": {"workout_type": WORKOUT_DOMAIN, "source": SOURCE_DOMAIN},
    },
    "profile": {
        "required": ("user_id", "age", "weight", "height", "fitness_goal"),
        "ranges": {"age": (18, 100), "weight": (30, 300), "height": (100, 250)},
        "lengths": {"user_id": (1, 100)},
        "domains": {"fitness_goal": GOAL_DOMAIN, "training_experience": EXPERIENCE_DOMAIN},
    },
    "feedback": {
        "required": ("user_id", "thumbs_up"),
        "ranges": {"actual_duration": (0, 300)},
        "lengths": {"comment": (0, 500)},
        "domains": {"actual_workout": WORKOUT_DOMAIN},
    },
}


def _rules(schema: str, columns: list[str]) -> list[tuple[str, Column]]:
    """(code, fails) for every rule of a schema that applies to the input's columns."""
    spec = SCHEMAS[schema]
    missing = lambda n: F.col(n).isNull() if n in columns else F.lit(True)
    rules = [(f"{n}_missing", missing(n)) for n in spec.get("required", ())]
    rules += [
        (f"{n}_range", ~F.col(n).between(low, high))
        for n, (low, high) in spec.get("ranges", {}).items()
        if n in columns
    ]
    rules += [
        (f"{n}_length", ~F.length(F.col(n).cast("string")).between(low, high))
        for n, (low, high) in spec.get("lengths", {}).items()
        if n in columns
    ]
    rules += [
        (f"{n}_domain", ~F.col(n).isin(*domain)) for n, domain in spec.get("domains", {}).items() if n in columns
    ]
    if schema == "body_state" and {"readiness_score", "fatigue"} <= set(columns):
        r, f = F.col("readiness_score"), F.col("fatigue")
        in_range = r.between(0, 100) & f.between(1, 10)
        rules += [
            ("high_readiness_high_fatigue", in_range & (r > 80) & (f > 7)),
            ("low_readiness_low_fatigue", in_range & (r < 40) & (f < 3)),
        ]
    return rules


def validate(df: DataFrame, schema: str) -> DataFrame:
    """Add ``violations`` (codes of the failing rules, in rule order) and ``is_valid``."""
    codes = [F.when(fails, F.lit(code)) for code, fails in _rules(schema, df.columns)]
    checked = df.withColumn("violations", F.array_compact(F.array(*codes)))
    return checked.withColumn("is_valid", F.size("violations") == 0)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows."""
    valid = validated.where("is_valid").drop("violations", "is_valid")
    return valid, validated.where("NOT is_valid").drop("is_valid")


def quarantine_counts(validated: DataFrame) -> DataFrame:
    """Rows per violation code."""
    codes = validated.select(F.explode("violations").alias("violation"))
    return codes.groupBy("violation").agg(F.count(F.lit(1)).alias("row_count"))


def bmi() -> Column:
    return to_places(F.col("weight") / F.pow(F.col("height") / 100, 2), 2)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null count and percentage of each column, one row per column."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns])
    long = counted.unpivot("_rows", columns, "metric", "non_null")
    return long.select("metric", "non_null", (F.col("non_null") * 100.0 / F.col("_rows")).alias("coverage_pct"))


def source_profile(df: DataFrame) -> DataFrame:
    """Rows and date range of each source."""
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def top_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values over all rows; ties go by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.orderBy(F.desc("row_count"), column).limit(n)


def rows_per_file(df: DataFrame) -> DataFrame:
    """Exact row count of every file behind a file-based scan."""
    files = df.select(F.col("_metadata.file_path").alias("path"))
    return files.groupBy("path").agg(F.count(F.lit(1)).alias("row_count"))


def column_means(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Mean of every numeric column whose name contains one of the patterns."""
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and any(p in f.name.lower() for p in patterns)
    ]
    means = df.agg(*[F.avg(n).alias(n) for n in names])
    return means.unpivot([], names, "metric", "mean")


def latest_per_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row per key, the one with the highest version columns.

    The row_number filter is applied within each task before the shuffle as well, so a key
    with many versions sends one row per task.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    return df.withColumn("_n", F.row_number().over(newest_first)).where(F.col("_n") == 1).drop("_n")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(key), key, "left_anti")
