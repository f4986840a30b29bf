"""Bandit posteriors as aggregates over feedback.

There are 18 actions, so every aggregate here is reduced map-side to at most 18 rows per
task before its shuffle, however the feedback is spread over actions or users.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.scalars import dot, or_else
from pulseframe.operators.catalog import ACTION_COUNT, ALL_IDS, catalogue, decorate, id_array

GRID_STEPS = 1024
CONTEXT_SIZE = 7

# Context features with their default and divisor.
CONTEXT = (
    ("readiness_score", 50, 100),
    ("sleep_score", 50, 100),
    ("activity_score", 50, 100),
    ("hrv", 50, 100),
    ("resting_hr", 60, 100),
    ("fatigue", 5, 10),
    ("days_since_training", 1, 7),
)


# Why a row of feedback can't be learnt from.
NO_ACTION, UNKNOWN_ACTION = "no action", "unknown action"


def unusable_action(action: Column) -> Column:
    """Why no action can be learnt from this id; null where one can."""
    return F.when(action.isNull(), F.lit(NO_ACTION)).when(~action.between(0, ACTION_COUNT - 1), F.lit(UNKNOWN_ACTION))


def rejected_feedback(feedback: DataFrame) -> DataFrame:
    """The rows that posteriors, statistics and ``catalog.decorate`` leave out, with the ``reason``."""
    return feedback.withColumn("reason", unusable_action(F.col("action_id"))).where(F.col("reason").isNotNull())


def _known_action() -> Column:
    return F.col("action_id").between(0, ACTION_COUNT - 1)


def _counts(feedback: DataFrame, *keys: str, weight: Column | None = None) -> DataFrame:
    return feedback.groupBy("action_id", *keys).agg(
        F.sum("success").alias("successes"),
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("action_count"),
        F.sum("reward").alias("total_reward"),
    )


def _as_beta(df: DataFrame) -> DataFrame:
    return df.select(
        "action_id",
        (1 + F.col("successes")).cast("double").alias("alpha"),
        (1 + F.col("action_count") - F.col("successes")).cast("double").alias("beta"),
        "action_count",
        "total_reward",
    )


def beta_posterior(feedback: DataFrame, weight: str | None = None) -> DataFrame:
    """Beta(1, 1) prior updated by success counts; unseen actions keep the prior.

    ``feedback`` carries action_id, reward and success, one row per feedback; with
    ``weight`` a row stands for that many and holds their sums.
    """
    seen = _counts(feedback.where(_known_action()), weight=None if weight is None else F.col(weight))
    filled = {"successes": 0, "action_count": 0, "total_reward": 0.0}
    actions = catalogue(feedback.sparkSession).select("action_id")
    # At most one row per known action, so at most 18.
    return _as_beta(actions.join(F.broadcast(seen), "action_id", "left").fillna(filled))


def posterior_as_of_day(feedback: DataFrame) -> DataFrame:
    """The posterior before each day's feedback, for every (action, day) with feedback.

    Feedback is first reduced to one row per action and day, which bounds the window
    partitions by the number of days.
    """
    daily = _counts(feedback.where(_known_action()), "date")
    before = Window.partitionBy("action_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda name: F.coalesce(F.sum(name).over(before), F.lit(0))
    return daily.select(
        "action_id",
        "date",
        (1 + earlier("successes")).cast("double").alias("alpha"),
        (1 + earlier("action_count") - earlier("successes")).cast("double").alias("beta"),
        earlier("action_count").alias("prior_count"),
        F.coalesce(F.sum("total_reward").over(before), F.lit(0.0)).alias("prior_reward"),
    )


def posterior_mean() -> Column:
    return F.col("alpha") / (F.col("alpha") + F.col("beta"))


def action_statistics(posterior: DataFrame) -> DataFrame:
    """Counts, total and expected reward per action with its description."""
    return decorate(posterior).select(
        "action_id",
        "description",
        "action_count",
        "total_reward",
        posterior_mean().alias("expected_reward"),
    )


def as_vector(per_action: DataFrame, value: Column) -> Column:
    """A scalar subquery with one array element per action of the catalogue, in id order; an
    action without a row has a null, so that the others keep their places."""
    rows = per_action.where(_known_action()).select("action_id", value.alias("v"))
    by_id = F.map_from_entries(F.collect_list(F.struct("action_id", "v")))
    return rows.agg(F.transform(id_array(ALL_IDS), lambda i: F.try_element_at(by_id, i)).alias("v")).scalar()


def action_shares(decisions: DataFrame, posterior: DataFrame) -> DataFrame:
    """Share of each allowed action: posterior means normalised over the decision's ``allowed``.

    Works on the arrays of a row, so no decision is shuffled. Uniform when the means sum to 0.
    """
    means = F.col("_means")
    total = F.aggregate("allowed", F.lit(0.0), lambda acc, a: acc + means[a])
    uniform = 1.0 / F.size("allowed")
    share = lambda a: F.when(F.col("_total") > 0, means[a] / F.col("_total")).otherwise(uniform)
    entries = F.transform("allowed", lambda a: F.struct(a.alias("action_id"), share(a).alias("share")))
    kept = [c for c in decisions.columns if c != "allowed"]
    return (
        decisions.withColumn("_means", as_vector(posterior, posterior_mean()))
        .withColumn("_total", total)
        .select(*kept, F.inline(entries))
    )


def context_vector() -> Column:
    """Seven scaled state features with defaults."""
    return F.array(*[or_else(name, default).cast("double") / scale for name, default, scale in CONTEXT])


def pair_names() -> list[tuple[int, int]]:
    return [(i, j) for i in range(CONTEXT_SIZE) for j in range(i, CONTEXT_SIZE)]


def linear_statistics(decisions: DataFrame, context: str = "context") -> DataFrame:
    """Per action B = I + sum(x x') and f = sum(reward x) as upper-triangle columns.

    ``decisions`` carries action_id, reward and the context array.
    """
    x = lambda i: F.col(context)[i]
    products = [
        (F.sum(x(i) * x(j)) + (1.0 if i == j else 0.0)).alias(f"b_{i}_{j}") for i, j in pair_names()
    ]
    moments = [F.sum(F.col("reward") * x(i)).alias(f"f_{i}") for i in range(CONTEXT_SIZE)]
    return (
        decisions.where(_known_action())
        .groupBy("action_id")
        .agg(F.count(F.lit(1)).alias("action_count"), *products, *moments)
    )


LINEAR_SCHEMA = "action_id int, theta array<double>, precision_inverse array<double>"


def _solve(stats: pd.DataFrame) -> pd.DataFrame:
    """Posterior mean and the upper triangle of the inverse of B for the rows given."""
    rows = []
    for row in stats.to_dict("records"):
        b = np.zeros((CONTEXT_SIZE, CONTEXT_SIZE))
        for i, j in pair_names():
            b[i, j] = b[j, i] = row[f"b_{i}_{j}"]
        inverse = np.linalg.inv(b)
        theta = inverse @ np.array([row[f"f_{i}"] for i in range(CONTEXT_SIZE)])
        rows.append((row["action_id"], theta.tolist(), [float(inverse[i, j]) for i, j in pair_names()]))
    return pd.DataFrame(rows, columns=["action_id", "theta", "precision_inverse"])


def linear_posterior(statistics: DataFrame) -> DataFrame:
    """Posterior mean and covariance of each action (at most 18 systems of size 7).

    Actions without feedback keep the prior: mean 0, covariance I.
    """
    solved = statistics.groupBy("action_id").applyInPandas(_solve, LINEAR_SCHEMA)
    prior_mean = F.array(*[F.lit(0.0)] * CONTEXT_SIZE)
    prior_inverse = F.array(*[F.lit(1.0 if i == j else 0.0) for i, j in pair_names()])
    actions = catalogue(statistics.sparkSession).select("action_id")
    return actions.join(F.broadcast(solved), "action_id", "left").select(
        "action_id",
        F.coalesce("theta", prior_mean).alias("theta"),
        F.coalesce("precision_inverse", prior_inverse).alias("precision_inverse"),
    )


def expected_reward(decisions: DataFrame, linear: DataFrame) -> DataFrame:
    """Add the linear model's expected reward of the served action."""
    means = linear.select("action_id", "theta")
    joined = decisions.join(F.broadcast(means), "action_id")
    return joined.withColumn("expected_reward", dot(F.col("theta"), F.col("context"))).drop("theta")


def beta_quantiles(alpha: float, beta: float, steps: int = GRID_STEPS) -> list[float]:
    """Quantiles of Beta(alpha, beta) at evenly spaced levels.

    The density is integrated on a grid around the mean; the two end levels are taken a
    quarter step inside so that the outer cells keep the tails' weight.
    """
    mean = alpha / (alpha + beta)
    sd = np.sqrt(mean * (1 - mean) / (alpha + beta + 1))
    low, high = max(0.0, mean - 12 * sd), min(1.0, mean + 12 * sd)
    edges = np.linspace(low, high, 40_001)
    x = (edges[:-1] + edges[1:]) / 2
    log_density = (alpha - 1) * np.log(x) + (beta - 1) * np.log1p(-x)
    mass = np.exp(log_density - log_density.max())
    cumulative = np.concatenate([[0.0], np.cumsum(mass)])
    levels = np.arange(steps + 1) / steps
    levels[0], levels[-1] = 0.25 / steps, 1 - 0.25 / steps
    return np.interp(levels, cumulative / cumulative[-1], edges).tolist()


def quantile_grids(posterior: DataFrame) -> DataFrame:
    """Add ``cells``, the quantile grid of each action's Beta posterior as (low, width) cells (18 rows)."""

    def grids(batches):
        for batch in batches:
            pairs = zip(batch["alpha"], batch["beta"], strict=True)
            edges = [np.array(beta_quantiles(a, b)) for a, b in pairs]
            cells = [
                [{"low": float(low), "width": float(width)} for low, width in zip(e[:-1], np.diff(e), strict=True)]
                for e in edges
            ]
            yield batch[["action_id"]].assign(cells=cells)

    # 18 rows: one Python worker is enough.
    return posterior.select("action_id", "alpha", "beta").coalesce(1).mapInPandas(
        grids, "action_id int, cells array<struct<low: double, width: double>>"
    )
