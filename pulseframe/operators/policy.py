"""Choosing an action for each state: rules, greedy, and posterior sampling.

The allowed actions of a state sit in an array on its row. Scoring and arg-max run over
that array, so a decision is never exploded, shuffled or grouped; the model side is 18
values attached as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.draws import digest_normals, digest_uniforms
from pulseframe.functions.scalars import dot, one_decimal, or_else
from pulseframe.operators.catalog import ACTION_COUNT, decorate, id_array, ids_of_intensity, ids_within
from pulseframe.operators.posterior import GRID_STEPS, as_vector, pair_names, posterior_mean, quantile_grids
from pulseframe.operators.safety import with_allowed


def first_allowed_of(ids: list[int]) -> Column:
    return F.array_min(F.array_intersect("allowed", id_array(ids)))


def rule_policy(states: DataFrame) -> DataFrame:
    """Add ``action_id`` by the first rule that applies to the state and its ``allowed`` actions."""
    exhausted = (or_else("readiness_score", 50) < 40) | (or_else("sleep_duration_hours", 7) < 5)
    choice = F.coalesce(
        F.when(exhausted, F.lit(0)),
        F.when(or_else("fatigue", 5) >= 7, first_allowed_of(ids_within(("RECOVERY",)))),
        F.when(or_else("days_since_training", 1) >= 3, first_allowed_of(ids_of_intensity("MEDIUM"))),
        first_allowed_of(ids_of_intensity("LOW")),
        F.array_min("allowed"),
        F.lit(0),
    )
    return states.withColumn("action_id", choice)


def _lowest_cost(entries: Column, score) -> Column:
    """Id of the entry with the highest ``score``; the lowest id wins a tie, and 0 stands for none."""
    ranked = F.transform(entries, lambda e: F.struct((-score(e)).alias("cost"), e["id"].alias("id")))
    return F.coalesce(F.array_min(ranked)["id"], F.lit(0))


def candidate_actions(states: DataFrame) -> DataFrame:
    """One row per state and allowed action, with the action's attributes."""
    exploded = states.withColumn("action_id", F.explode("allowed")).drop("allowed")
    return decorate(exploded)


def greedy(states: DataFrame, posterior: DataFrame) -> DataFrame:
    """Add the allowed action with the highest posterior mean."""
    scored = states.withColumn("_means", as_vector(posterior, posterior_mean()))
    means = F.transform("allowed", lambda a: F.struct(a.alias("id"), F.col("_means")[a].alias("mean")))
    return scored.withColumn("action_id", _lowest_cost(means, lambda e: e["mean"])).drop("_means")


def _key_columns(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def thompson(states: DataFrame, posterior: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """Add the allowed action with the highest draw from its Beta posterior.

    ``keys`` identify a decision; draws depend on the seed, the keys and the action only.
    The grids are read in one place, which lets the optimizer keep them out of the rows.
    """
    grids = as_vector(quantile_grids(posterior), F.col("cells"))

    def choice(row: Column) -> Column:
        def found(a: Column) -> Column:
            place = row["uniforms"][a] * GRID_STEPS
            cell = F.get(F.col("_grids")[a], F.floor(place).cast("int"))
            return F.struct(a.alias("id"), (place - F.floor(place)).alias("within"), cell.alias("cell"))

        return _lowest_cost(F.transform("allowed", found), lambda f: f["cell"]["low"] + f["within"] * f["cell"]["width"])

    # The numbers of a state are drawn once, as the only element of an outer array.
    uniforms = F.array(*digest_uniforms(seed, _key_columns(keys), ACTION_COUNT))
    scored = states.withColumns({"_state": F.array(F.struct(uniforms.alias("uniforms"))), "_grids": grids})
    return scored.withColumn("action_id", F.transform("_state", choice)[0]).drop("_state", "_grids")


def linear_thompson(
    states: DataFrame, linear: DataFrame, seed: int, keys: list[str], sigma: float = 1.0
) -> DataFrame:
    """Add the allowed action with the highest sampled linear reward.

    The sampled reward theta'x with theta ~ N(m, s^2 C) is itself normal with mean m'x and
    variance s^2 x'Cx, so one draw per decision and action replaces a draw of theta.
    """
    model = as_vector(linear, F.struct("theta", "precision_inverse"))
    x = F.col("context")
    pairs = F.array(*[(1.0 if i == j else 2.0) * x[i] * x[j] for i, j in pair_names()])
    models = F.transform(
        "allowed",
        lambda a: F.struct(
            a.alias("id"),
            F.col("_model")[a].alias("m"),
        ),
    )

    def choice(row: Column) -> Column:
        def sampled(f: Column) -> Column:
            variance = F.greatest(F.lit(0.0), dot(f["m"]["precision_inverse"], row["pairs"]))
            return dot(f["m"]["theta"], row["x"]) + sigma * F.sqrt(variance) * row["normals"][f["id"]]

        return _lowest_cost(models, sampled)

    # Products of the context and normal numbers are made once per state, as the only element of an
    # outer array. Both columns are read in one place, which lets the optimizer keep the model out of the rows.
    normals = F.array(*digest_normals(seed, _key_columns(keys), ACTION_COUNT))
    once = F.array(F.struct(pairs.alias("pairs"), x.alias("x"), normals.alias("normals")))
    scored = states.withColumns({"_state": once, "_model": model})
    return scored.withColumn("action_id", F.transform("_state", choice)[0]).drop("_state", "_model")


# Texts of the rationale.
WHY_REST = "Rest day recommended due to low readiness ({}) or insufficient sleep ({}h)"
WHY_LOW = "Low intensity {} recommended based on current recovery state"
WHY_HARD = "{} intensity {} recommended - you're well recovered"


def fill_all(template: str, *values: Column) -> Column:
    """The template with each placeholder replaced by the next column."""
    texts = [F.lit(part) for part in template.split("{}")]
    inserts = [v.cast("string") for v in values]
    return F.concat(texts[0], *[x for pair in zip(inserts, texts[1:], strict=True) for x in pair])


def rationale() -> Column:
    """Why the action was chosen, from its type and intensity."""
    rested = one_decimal(or_else("sleep_duration_hours", 7).cast("double"))
    kind, level = F.lower("workout_type"), F.col("intensity")
    return (
        F.when(F.col("workout_type") == "REST", fill_all(WHY_REST, or_else("readiness_score", 50), rested))
        .when(level == "LOW", fill_all(WHY_LOW, kind))
        .otherwise(fill_all(WHY_HARD, level, kind))
    )


def recommend(states: DataFrame, choose, profile: str = "declared") -> DataFrame:
    """States to full recommendation rows.

    ``choose`` maps states with ``allowed`` to states with ``action_id``, for example
    ``rule_policy`` or ``lambda s: greedy(s, posterior)``.
    """
    chosen = decorate(choose(with_allowed(states, profile)))
    return chosen.select(
        "user_id",
        "date",
        "action_id",
        "workout_type",
        "intensity",
        "duration_minutes",
        "description",
        "is_safe",
        F.col("message").alias("safety_message"),
        rationale().alias("rationale"),
    )
