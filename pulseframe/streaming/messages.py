"""The learning loop's messages: building them for a topic and reading them from one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators.posterior import unusable_action

# Event types and topics of the loop, and the outcome fields of a feedback message.
PLAN_SERVED, FEEDBACK_RECEIVED = "plan_served", "feedback_received"
PLAN_TOPIC, FEEDBACK_TOPIC = "training.plan.served", "training.user.feedback"
OUTCOMES = {
    "completion": "double",
    "adherence_ratio": "double",
    "recovery_change": "double",
    "satisfaction": "double",
    "overtraining": "boolean",
}

_OUTCOME_FIELDS = ", ".join(f"{name}: {kind}" for name, kind in OUTCOMES.items())
FEEDBACK_SCHEMA = (
    "event_type string, event_id string, user_id string, timestamp string, action_id int, reward double, "
    f"feedback struct<{_OUTCOME_FIELDS}>"
)


def feedback_messages(scored: DataFrame, timestamp: str = "timestamp", keep: list[str] | None = None) -> DataFrame:
    """Scored feedback as topic and JSON value, beside the columns to keep; an ``event_id`` goes along
    where there is one."""
    present = [name for name in OUTCOMES if name in scored.columns]
    envelope = F.struct(
        F.lit(FEEDBACK_RECEIVED).alias("event_type"),
        *([F.col("event_id").cast("string").alias("event_id")] if "event_id" in scored.columns else []),
        F.col("user_id").cast("string").alias("user_id"),
        F.col(timestamp).cast("string").alias("timestamp"),
        "action_id",
        "reward",
        F.struct(*present).alias("feedback"),
    )
    return scored.select(*(keep or []), F.lit(FEEDBACK_TOPIC).alias("topic"), F.to_json(envelope).alias("value"))


def plan_messages(recommendations: DataFrame, timestamp: str = "date") -> DataFrame:
    """Recommendations as topic and JSON value."""
    carried = [c for c in recommendations.columns if c not in ("user_id", timestamp)]
    envelope = F.struct(
        F.lit(PLAN_SERVED).alias("event_type"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col(timestamp).cast("string").alias("timestamp"),
        "action_id",
        F.struct(*carried).alias("recommendation"),
    )
    return recommendations.select(F.lit(PLAN_TOPIC).alias("topic"), F.to_json(envelope).alias("value"))


# Why a message or a feedback row can't be learnt from.
UNREADABLE, NO_TYPE, WRONG_TYPE = "unreadable", "no event type", "wrong type"
LATE, REPEATED = "late", "repeated"


def judged_feedback(messages: DataFrame) -> DataFrame:
    """Adds the fields of feedback and ``reason``, which is null where the row can be learnt from.

    Messages of other event types belong to others and are left out; every other message is kept,
    whether it can be read or not.
    """
    event = F.from_json(
        F.col("value").cast("string"), f"{FEEDBACK_SCHEMA}, bad string", {"columnNameOfCorruptRecord": "bad"}
    )
    read = messages.withColumn("e", event)
    kind, bad = F.col("e.event_type"), F.col("e.bad").isNotNull()
    reason = F.coalesce(
        F.when(F.col("e").isNull() | (bad & F.try_parse_json(F.col("value").cast("string")).isNull()), F.lit(UNREADABLE)),
        F.when(bad, F.lit(WRONG_TYPE)),
        F.when(kind.isNull(), F.lit(NO_TYPE)),
        unusable_action(F.col("e.action_id")),
    )
    mine = read.where(F.coalesce(kind, F.lit(FEEDBACK_RECEIVED)) == FEEDBACK_RECEIVED)
    fields = ["event_id", "user_id", "timestamp", "action_id"]
    return mine.select(
        *messages.columns, *[F.col(f"e.{f}").alias(f) for f in fields], F.col("e.feedback.*"), reason.alias("reason")
    )


def parse_feedback(messages: DataFrame) -> DataFrame:
    """JSON values to feedback rows that can be learnt from; :func:`judged_feedback` tells of the others."""
    good = judged_feedback(messages).where(F.col("reason").isNull())
    return good.select("event_id", "user_id", "timestamp", "action_id", *OUTCOMES)


def kafka_stream(spark: SparkSession, servers: str, topic: str = FEEDBACK_TOPIC) -> DataFrame:
    """Messages of a topic; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
