"""Comparing policies on logged episodes.

An episode log has one row per (policy, episode) with episodes numbered from 0. A policy
may hold most of the log, so ordered work is cut into fixed ranges of episodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.bounded import CHUNK_ROWS, by_key
from pulseframe.operators.catalog import INTENSITY_RANK

ROLLING = 50
TAIL = 100


def is_optimal() -> Column:
    return F.col("action_id") == F.col("optimal_action_id")


# Lowest readiness, highest fatigue (None for any), reference action and ideal
# intensity; the first row that holds decides, otherwise both are 0.
REFERENCE = ((70, 4, 8, 3), (55, 6, 13, 2), (40, None, 4, 1), (30, None, 1, 0))


def _by_reference(value: int) -> Column:
    """Column ``value`` of the first reference row that the state meets."""
    readiness, fatigue = F.col("readiness_score"), F.col("fatigue")
    met = lambda low, high: (readiness >= low) & (F.lit(True) if high is None else fatigue <= high)
    return F.coalesce(*[F.when(met(row[0], row[1]), F.lit(row[value])) for row in REFERENCE], F.lit(0))


def reference_policy() -> Column:
    """The action a fully informed coach would choose, from readiness and fatigue."""
    return _by_reference(2)


def with_intensity_mismatch(states: DataFrame) -> DataFrame:
    """Add ideal intensity, distance of the served ``intensity_rank`` from it, overtraining flag and base score."""
    hard = F.col("intensity_rank") == INTENSITY_RANK["HIGH"]
    worn_out = (F.col("fatigue") > 7) | (F.col("readiness_score") < 40)
    penalty = F.when(F.col("overtraining"), 0.5).otherwise(0.0)
    return (
        states.withColumns({"ideal_intensity": _by_reference(3), "overtraining": hard & worn_out})
        .withColumn("mismatch", F.abs(F.col("intensity_rank") - F.col("ideal_intensity")))
        .withColumn("base_score", 0.8 - 0.25 * F.col("mismatch") - penalty)
    )


def policy_sizes(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("policy").agg(F.count(F.lit(1)).alias("n"))


def with_size(episodes: DataFrame) -> DataFrame:
    """Add ``n``, the episodes of the row's policy; the log itself is not shuffled for it."""
    return episodes.withColumn("n", by_key(policy_sizes(episodes), "policy", F.col("n")))


def policy_metrics(episodes: DataFrame) -> DataFrame:
    """Reward, optimality and overtraining per policy, and the means of its first and second half."""
    late = F.col("episode") >= F.floor(F.col("n") / 2)
    metrics = (
        with_size(episodes)
        .groupBy("policy")
        .agg(
            F.avg("reward").alias("mean_reward"),
            F.stddev_pop("reward").alias("std_reward"),
            F.sum("reward").alias("cumulative_reward"),
            F.avg(is_optimal().cast("int")).alias("optimal_action_rate"),
            F.avg(F.col("is_overtraining").cast("int")).alias("overtraining_rate"),
            F.avg(F.when(~late, F.col("reward"))).alias("first_half_mean_reward"),
            F.avg(F.when(late, F.col("reward"))).alias("second_half_mean_reward"),
        )
    )
    gain = F.col("second_half_mean_reward") - F.col("first_half_mean_reward")
    return metrics.withColumn("learning_improvement", gain)


def policy_uplift(metrics: DataFrame, baselines: list[str]) -> DataFrame:
    """Percent improvement of every policy's mean reward over each baseline policy's."""
    mean = F.col("mean_reward")

    def over(baseline: str) -> Column:
        base = metrics.where(F.col("policy") == baseline).select(F.max("mean_reward")).scalar()
        return ((mean - base) / F.greatest(F.abs(base), F.lit(1e-9)) * 100).alias(f"uplift_vs_{baseline}_pct")

    return metrics.select("policy", "mean_reward", *[over(b) for b in baselines])


def rolling_reward(
    episodes: DataFrame, window: int = ROLLING, chunk_rows: int = CHUNK_ROWS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Mean reward of the last ``window`` episodes of a policy.

    Episodes are cut into ranges of ``chunk_rows``. The last window - 1 rows of a range are
    copied into the next one as its run-up and dropped after the window is taken.
    """
    if chunk_rows < window:
        raise ValueError("a range must hold at least one window")
    chunk = F.floor(F.col("episode") / chunk_rows)
    into_next = F.col("episode") % chunk_rows > chunk_rows - window
    spread = episodes.select("policy", "episode", "reward", *keep).withColumn(
        "_chunk", F.explode(F.when(into_next, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    )
    frame = Window.partitionBy("policy", "_chunk").orderBy("episode").rowsBetween(-(window - 1), 0)
    return (
        spread.withColumn("rolling_reward", F.avg("reward").over(frame))
        .where(chunk == F.col("_chunk"))
        .drop("_chunk")
    )


def convergence_episode(episodes: DataFrame, window: int = ROLLING, tail: int = TAIL) -> DataFrame:
    """First episode after ``window`` whose rolling reward reaches the lower quartile of the last
    ``tail`` rolling values; the number of episodes when none does.

    The quartile needs only the last tail + window episodes of a policy, so it is taken
    from those before the pass over all episodes.
    """
    sized = with_size(episodes)
    ending = sized.where(F.col("episode") > F.col("n") - tail - window)
    target = (
        rolling_reward(ending, window, keep=("n",))
        .where(F.col("episode") >= F.col("n") - tail)
        .groupBy("policy")
        .agg(F.percentile("rolling_reward", F.lit(0.25)).alias("target"), F.max("n").alias("n"))
    )
    rolled = rolling_reward(episodes, window).withColumn("_aim", by_key(target, "policy", F.struct("target", "n")))
    reached = (F.col("episode") > window) & (F.col("rolling_reward") >= F.col("_aim.target"))
    return rolled.groupBy("policy").agg(
        F.max("_aim.target").alias("target"),
        F.coalesce(F.min(F.when(reached, F.col("episode"))), F.max("_aim.n")).alias("convergence_episode"),
    )
