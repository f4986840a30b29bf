"""Health records to one row per user and day, and the alignment of several daily sources.

Every aggregate is keyed by (user_id, date) with map-side partial aggregation, so a
user holding a large share of the records costs no more than that user's number of days
after the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["user_id", "date"]

# Record types that feed each daily measure.
HEART_RATE_TYPES = ("heart_rate", "resting_heart_rate")
ACTIVITY_COLUMNS = {"steps": "steps", "active_energy": "active_calories", "basal_energy": "basal_calories"}


def _of_type(types: tuple[str, ...], value: str = "value") -> Column:
    return F.when(F.col("type").isin(*types), F.col(value))


def _day_sum(types: tuple[str, ...], value: str = "value") -> Column:
    """Sum over the day's records of some types: 0 when all are unreadable, NULL when there are none."""
    present = F.max(F.col("type").isin(*types))
    return F.when(present, F.coalesce(F.sum(_of_type(types, value)), F.lit(0.0)))


def daily_heart_rate(records: DataFrame) -> DataFrame:
    """Mean, minimum, maximum and sample deviation per day; the minimum stands for the resting rate."""
    return (
        records.where(F.col("type").isin(*HEART_RATE_TYPES))
        .groupBy(*KEYS)
        .agg(
            F.avg("value").alias("hr_mean"),
            F.min("value").alias("hr_min"),
            F.max("value").alias("hr_max"),
            F.stddev_samp("value").alias("hr_std"),
        )
        .withColumn("resting_hr", F.col("hr_min"))
    )


def daily_activity(records: DataFrame) -> DataFrame:
    """Daily sums of steps and energy as columns."""
    return (
        records.where(F.col("type").isin(*ACTIVITY_COLUMNS))
        .groupBy(*KEYS)
        .agg(*[_day_sum((kind,)).alias(name) for kind, name in ACTIVITY_COLUMNS.items()])
    )


def daily_sleep(records: DataFrame, duration: str = "duration") -> DataFrame:
    """Hours of all sleep records that start on the day."""
    return (
        records.where(F.col("type") == "sleep")
        .groupBy(*KEYS)
        .agg(F.coalesce(F.sum(duration), F.lit(0.0)).alias("sleep_duration_hours"))
    )


def daily_measures(records: DataFrame, duration: str = "duration") -> DataFrame:
    """All daily measures of one device in a single aggregation.

    Gives what a full outer join of the separate daily tables would, with one shuffle
    instead of one per table and per join. The daily mean of hrv is added.
    """
    heart = _of_type(HEART_RATE_TYPES)
    wanted = [*HEART_RATE_TYPES, *ACTIVITY_COLUMNS, "sleep", "hrv"]
    daily = (
        records.where(F.col("type").isin(*wanted))
        .groupBy(*KEYS)
        .agg(
            F.avg(heart).alias("hr_mean"),
            F.min(heart).alias("hr_min"),
            F.max(heart).alias("hr_max"),
            F.stddev_samp(heart).alias("hr_std"),
            *[_day_sum((kind,)).alias(name) for kind, name in ACTIVITY_COLUMNS.items()],
            _day_sum(("sleep",), duration).alias("sleep_duration_hours"),
            F.avg(_of_type(("hrv",))).alias("hrv"),
        )
    )
    return daily.withColumn("resting_hr", F.col("hr_min"))


def unify(sources: dict[str, DataFrame]) -> DataFrame:
    """Full outer alignment of daily sources on (user_id, date).

    ``sources`` is ordered by preference. A measure found in several sources keeps every
    original as ``<measure>_<source>`` and gets a canonical column with the first present
    value; a measure found in one source passes through. A source has one row per user and date.

    Two sources are joined, which shuffles each once. The rows of a full join no longer lie by their
    keys, so that a third source would shuffle them again: three and more are stacked and folded in
    one aggregation instead.
    """
    owners: dict[str, list[str]] = {}
    for label, df in sources.items():
        for name in df.columns:
            if name not in KEYS:
                owners.setdefault(name, []).append(label)
    shared = {name for name, labels in owners.items() if len(labels) > 1}
    renamed = [
        df.withColumnsRenamed({n: f"{n}_{label}" for n in df.columns if n in shared})
        for label, df in sources.items()
    ]
    if len(renamed) <= 2:
        joined = reduce(lambda a, b: a.join(b, KEYS, "full"), renamed)
    else:
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)
        # A column comes from one source alone, which has one row per key.
        joined = stacked.groupBy(*KEYS).agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns if c not in KEYS])
    canonical = {
        name: F.coalesce(*[F.col(f"{name}_{label}") for label in owners[name]])
        for name in owners
        if name in shared
    }
    return joined.withColumns(canonical) if canonical else joined


def concat_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all parts with their source name; a column missing in a part is NULL there."""
    tagged = [df.withColumn("source", F.lit(label)) for label, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
