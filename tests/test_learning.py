"""Rewards, posteriors and sampled decisions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions.scalars import one_decimal
from pulseframe.operators import features as ft
from pulseframe.operators import policy as po
from pulseframe.operators import posterior as pt
from pulseframe.operators import safety as sf
from pulseframe.operators.reward import normalise_form_feedback, with_reward
from pulseframe.plans.inputs import source


def test_reward_defaults_and_weights(spark):
    df = spark.createDataFrame([(1, None, None)], "action_id int, completion double, overtraining boolean")
    assert with_reward(df).first().reward == 0.5 + 0.3 * 0.5
    bad = spark.createDataFrame([(1.0, 0.5, 0.2, 1.0, True)], "completion double, adherence_ratio double, recovery_change double, satisfaction double, overtraining boolean")
    assert abs(with_reward(bad).first().reward - (1 + 0.25 - 0.2 + 0.3 - 2)) < 1e-12
    weights = {"completion": 2.0, "adherence": 0.0, "recovery_change": 0.0, "satisfaction": 0.0, "overtraining_penalty": 0.0}
    assert with_reward(bad, weights).first().reward == 2.0


def test_success_is_strict(spark):
    df = spark.createDataFrame([(0.0,)], "completion double").withColumns(
        {"adherence_ratio": F.lit(1.0), "satisfaction": F.lit(0.0)}
    )
    row = with_reward(df).first()
    assert (row.reward, row.success) == (0.5, 0)


def test_form_feedback(spark):
    df = spark.createDataFrame([(True, 8.0), (False, 1.0)], "completed boolean, satisfaction double")
    got = [(r.completion, r.satisfaction) for r in normalise_form_feedback(df).collect()]
    assert got == [(1.0, 0.8), (0.0, 1.0)]


def feedback(spark, rows):
    df = spark.createDataFrame(rows, "action_id int, date date, reward double")
    return df.withColumn("success", (F.col("reward") > 0.5).cast("int"))


D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def test_unseen_actions_keep_the_prior(spark):
    post = {r.action_id: r for r in pt.beta_posterior(feedback(spark, [(3, D1, 1.0), (3, D1, 0.1), (99, D1, 1.0)])).collect()}
    assert len(post) == 18
    assert (post[3].alpha, post[3].beta, post[3].action_count) == (2.0, 2.0, 2)
    assert (post[4].alpha, post[4].beta, post[4].action_count, post[4].total_reward) == (1.0, 1.0, 0, 0.0)


def test_posterior_as_of_day_excludes_the_day(spark):
    rows = [(1, D1, 1.0), (1, D1, 0.0), (1, D2, 1.0)]
    got = {r.date: (r.alpha, r.beta) for r in pt.posterior_as_of_day(feedback(spark, rows)).collect()}
    assert got == {D1: (1.0, 1.0), D2: (2.0, 2.0)}


def test_posterior_does_not_depend_on_partitioning(spark, folder):
    scored = with_reward(source(spark, folder, "fb"))
    a = pt.beta_posterior(scored).orderBy("action_id").collect()
    b = pt.beta_posterior(scored.repartition(7)).orderBy("action_id").collect()
    for x, y in zip(a, b, strict=True):
        assert (x.alpha, x.beta) == (y.alpha, y.beta)
        assert x.alpha + x.beta - 2 == x.action_count


def test_greedy_takes_the_first_of_a_tie(spark):
    prior = pt.beta_posterior(feedback(spark, [(17, D1, 0.0)]))
    df = spark.createDataFrame([([17, 4, 6],), ([17],), ([],)], "allowed array<int>")
    assert [r.action_id for r in po.greedy(df, prior).collect()] == [4, 17, 0]


def test_shares_sum_to_one(spark):
    prior = pt.beta_posterior(feedback(spark, [(2, D1, 1.0)]))
    df = spark.createDataFrame([(1, [0, 1, 2])], "id int, allowed array<int>")
    shares = {r.action_id: r.share for r in pt.action_shares(df, prior).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-12
    assert abs(shares[2] - (2 / 3) / (2 / 3 + 1)) < 1e-12


@pytest.mark.parametrize(("a", "b"), [(1, 1), (1, 5), (30, 12), (4000, 1800)])
def test_beta_quantiles(a, b):
    grid = np.array(pt.beta_quantiles(a, b))
    draws = np.random.default_rng(0).beta(a, b, 400_000)
    sd = draws.std()
    for level in (0.01, 0.25, 0.5, 0.75, 0.99):
        ours = np.interp(level, np.arange(1025) / 1024, grid)
        assert abs(ours - np.quantile(draws, level)) < 0.03 * sd + 2e-4
    assert abs(grid.mean() - a / (a + b)) < 0.02 * sd


def thompson_inputs(spark, folder):
    opened = sf.with_allowed(ft.with_high_load_days(source(spark, folder, "states"))).select("user_id", "date", "allowed")
    return opened, pt.beta_posterior(with_reward(source(spark, folder, "fb")))


def test_draws_are_repeatable_and_allowed(spark, folder):
    opened, post = thompson_inputs(spark, folder)
    keys = ["user_id", "date"]
    run = lambda df, seed: {(r.user_id, r.date): r.action_id for r in po.thompson(df, post, seed, keys).collect()}
    first = run(opened, 1)
    assert first == run(opened.repartition(5), 1)
    assert first != run(opened, 2)
    allowed = {(r.user_id, r.date): r.allowed for r in opened.collect()}
    assert all(a in allowed[k] for k, a in first.items())


def test_draws_follow_the_posterior(spark):
    """Two actions with known posteriors: the choice rate matches a direct simulation."""
    rows = [(1, D1, 1.0)] * 5 + [(1, D1, 0.0)] * 4 + [(2, D1, 1.0)] * 6 + [(2, D1, 0.0)] * 3
    post = pt.beta_posterior(feedback(spark, rows))
    df = spark.range(20_000).withColumn("allowed", F.array(F.lit(1), F.lit(2)))
    rate = po.thompson(df, post, 7, ["id"]).agg(F.avg((F.col("action_id") == 2).cast("int"))).first()[0]
    rng = np.random.default_rng(1)
    expected = np.mean(rng.beta(7, 4, 200_000) > rng.beta(6, 5, 200_000))
    assert abs(rate - expected) < 0.02


def served(spark, n=300):
    rng = np.random.default_rng(3)
    x, actions, rewards = rng.random((n, 7)), rng.integers(0, 4, n), rng.random(n)
    rows = [(i, int(a), float(r), [float(v) for v in v]) for i, (a, r, v) in enumerate(zip(actions, rewards, x, strict=True))]
    return spark.createDataFrame(rows, "id int, action_id int, reward double, context array<double>"), x, actions, rewards


def test_linear_model_against_numpy(spark):
    df, x, actions, rewards = served(spark)
    linear = pt.linear_posterior(pt.linear_statistics(df))
    got = {r.id: r.expected_reward for r in pt.expected_reward(df, linear).collect()}
    for a in range(4):
        xa = x[actions == a]
        theta = np.linalg.solve(np.eye(7) + xa.T @ xa, xa.T @ rewards[actions == a])
        for i in np.flatnonzero(actions == a):
            assert abs(got[i] - theta @ x[i]) < 1e-9
    prior = {r.action_id: r for r in linear.collect()}[9]
    assert prior.theta == [0.0] * 7 and prior.precision_inverse[0] == 1.0 and prior.precision_inverse[1] == 0.0


def test_linear_draws_follow_the_posterior(spark):
    df, x, actions, rewards = served(spark)
    linear = pt.linear_posterior(pt.linear_statistics(df))
    point = [float(v) for v in x[0]]
    many = spark.range(20_000).withColumns(
        {"allowed": F.array(F.lit(0), F.lit(1)), "context": F.array(*[F.lit(v) for v in point])}
    )
    rate = po.linear_thompson(many, linear, 5, ["id"]).agg(F.avg((F.col("action_id") == 1).cast("int"))).first()[0]
    moments = []
    for a in (0, 1):
        xa = x[actions == a]
        b = np.eye(7) + xa.T @ xa
        moments.append((np.linalg.solve(b, xa.T @ rewards[actions == a]) @ x[0], x[0] @ np.linalg.inv(b) @ x[0]))
    (m0, v0), (m1, v1) = moments
    normal = np.random.default_rng(0).normal(0, 1, 200_000)
    assert abs(rate - np.mean(normal * np.sqrt(v0 + v1) + m1 - m0 > 0)) < 0.02


def test_one_decimal_rounds_like_python(spark):
    values = [5.85, 5.95, 0.25, 0.75, 2.675, 0.05, 7.0, 0.0, 1.15, 12.345, 9.95, 8.449999999999999]
    values += [float(v) for v in np.round(np.random.default_rng(0).uniform(0, 15, 5000), 2)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.t for r in df.select(one_decimal(F.col("x")).alias("t")).collect()]
    assert got == [f"{v:.1f}" for v in values]
