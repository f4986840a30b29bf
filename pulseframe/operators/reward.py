"""Feedback to reward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.scalars import optional, or_else

# Default weights of the reward and the value above which it is a success.
WEIGHTS = {
    "completion": 1.0,
    "adherence": 0.5,
    "recovery_change": -1.0,
    "satisfaction": 0.3,
    "overtraining_penalty": -2.0,
}
SUCCESS_ABOVE = 0.5


def reward(columns: list[str], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the outcomes. ``recovery_change`` is the decline in recovery.

    Outcomes that are absent or NULL take their defaults. ``weights`` replaces the whole set.
    """
    w = weights or WEIGHTS
    value = lambda name, default: or_else(optional(columns, name, "double"), default)
    overtrained = F.coalesce(optional(columns, "overtraining", "boolean"), F.lit(False))
    return (
        w["completion"] * value("completion", 0.0)
        + w["adherence"] * value("adherence_ratio", 1.0)
        + w["recovery_change"] * value("recovery_change", 0.0)
        + w["satisfaction"] * value("satisfaction", 0.5)
        + F.when(overtrained, F.lit(w["overtraining_penalty"])).otherwise(0.0)
    )


def with_reward(feedback: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``reward`` and ``success`` (0 or 1)."""
    scored = feedback.withColumn("reward", reward(feedback.columns, weights))
    return scored.withColumn("success", (F.col("reward") > SUCCESS_ABOVE).cast("int"))


def normalise_form_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback as the app form sends it (completed, satisfaction 1-10) in the reward's terms."""
    satisfaction = F.col("satisfaction").cast("double")
    return feedback.withColumns(
        {
            "completion": F.col("completed").cast("int").cast("double"),
            "satisfaction": F.when(satisfaction > 1, satisfaction / 10).otherwise(satisfaction),
        }
    )
