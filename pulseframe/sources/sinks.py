"""Writers. Each takes the target path from the caller."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators.quality import latest_per_key

# Defaults of an exercise entry.
EXERCISE_DEFAULTS = {"exercise_name": "", "sets": 0, "reps": 0, "weight_kg": 0.0, "rest_seconds": 60}

# Topics of the agent's events; every other type goes to the last one.
TOPICS = {
    "training.plan.adjusted": "training.plan.served",
    "agent.user.feedback": "training.user.feedback",
    "agent.daily_summary": "agent.conversation.events",
    "agent.micro_goal.set": "agent.conversation.events",
}
OTHER_TOPIC = "agent.conversation.events"


def _rebalanced(df: DataFrame, column: str) -> DataFrame:
    """Rows gathered by a partition column before writing: few files for quiet values, and several
    tasks for busy ones, as adaptive execution finds them."""
    return df.hint("rebalance", F.col(column))


def write_monthly(df: DataFrame, path: str, date: str = "date") -> None:
    """Parquet partitioned by calendar month."""
    month = F.date_format(date, "yyyy-MM").alias("year_month")
    monthly = _rebalanced(df.select("*", month), "year_month")
    monthly.write.mode("overwrite").partitionBy("year_month").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_views(views: dict[str, DataFrame], folder: str, prefix: str) -> list[str]:
    """One CSV folder per non-empty view; returns the paths written."""
    written = []
    for name, df in views.items():
        if not df.isEmpty():
            write_csv(df, f"{folder}/{prefix}_{name}")
            written.append(f"{folder}/{prefix}_{name}")
    return written


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def explode_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with an ``exercises`` array to one row per exercise; session fields repeat."""
    fields = sessions.schema["exercises"].dataType.elementType.names
    rows = sessions.withColumn("e", F.explode("exercises")).drop("exercises")
    values = {
        name: F.coalesce(F.col(f"e.{name}"), F.lit(EXERCISE_DEFAULTS[name]))
        if name in EXERCISE_DEFAULTS
        else F.col(f"e.{name}")
        for name in fields
    }
    absent = {name: F.lit(value) for name, value in EXERCISE_DEFAULTS.items() if name not in fields}
    return rows.withColumns({**values, **absent}).drop("e")


def append_sessions(sessions: DataFrame, path: str) -> None:
    """Append exploded sessions to the log table without rewriting it."""
    explode_sessions(sessions).write.mode("append").parquet(path)


def route_events(events: DataFrame) -> DataFrame:
    """Add the topic of the agent's rule and of the learning loop's rule, and the JSON envelope.

    ``events`` carries event_type, user_id, timestamp and a ``payload`` struct.
    """
    topic = F.coalesce(
        *[F.when(F.col("event_type") == kind, F.lit(name)) for kind, name in TOPICS.items()], F.lit(OTHER_TOPIC)
    )
    loop_topic = F.when(F.contains("event_type", F.lit("feedback")), "training.user.feedback").otherwise(
        "training.plan.served"
    )
    envelope = F.to_json(F.struct("event_type", "user_id", "timestamp", "payload"))
    return events.select(topic.alias("topic"), loop_topic.alias("loop_topic"), envelope.alias("value"))


def write_snapshot(posterior: DataFrame, path: str, as_of: dt.date) -> None:
    """Store a version of the posterior; re-writing the same version replaces it."""
    versioned = posterior.withColumn("as_of", F.lit(as_of))
    versioned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)


def read_snapshot(spark: SparkSession, path: str, as_of: dt.date | None = None) -> DataFrame:
    """The latest stored posterior not newer than ``as_of``."""
    versions = spark.read.parquet(path)
    if as_of is not None:
        versions = versions.where(F.col("as_of") <= F.lit(as_of))
    newest = versions.select(F.max("as_of")).scalar()
    return versions.where(F.col("as_of") == newest)


def upsert_states(states: DataFrame, path: str, version: str = "created_at") -> None:
    """Merge states into a table that keeps the newest row per (user_id, date).

    Only day partitions between the first and the last day of ``states`` are read, and only those
    that it touches are replaced. Rows of one version are ordered by a hash of all their columns.
    """
    keys = ["user_id", "date"]
    try:
        stored = states.sparkSession.read.parquet(path)
    except AnalysisException as error:
        # Any other fault must not pass for a first write, which would drop the stored rows.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    if stored is not None:
        touched = states.select("date").distinct()
        days = [states.select(f("date")).scalar() for f in (F.min, F.max)]
        within = stored.where(F.col("date").between(*days)).join(touched, "date", "left_semi")
        states = states.unionByName(within.select(*states.columns))
    tie = F.xxhash64(*[F.col(c).cast("string") for c in sorted(states.columns)])
    newest = latest_per_key(states.withColumn("_tie", tie), keys, [version, "_tie"]).drop("_tie")
    writer = _rebalanced(newest, "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date").parquet(path)
