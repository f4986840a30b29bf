"""Queries over feedback, posteriors and policy evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators import evaluate as ev
from pulseframe.operators import posterior as pt
from pulseframe.operators.catalog import decorate
from pulseframe.operators.quality import orphans
from pulseframe.operators.reward import normalise_form_feedback, with_reward
from pulseframe.plans.inputs import source
from pulseframe.plans.oracle_parts import ACTIONS, POSTERIOR, SCORED
from pulseframe.plans.registry import query

BETA = {"actions": ACTIONS, **POSTERIOR}


def scored(spark, folder):
    return with_reward(source(spark, folder, "fb"))


@query(
    "feedback_reward",
    """select user_id, action_id, session_id, date, reward, cast(reward > 0.5 as integer) as success from scored""",
    "fb",
    "reward",
    {"scored": SCORED},
)
def feedback_reward(spark, folder):
    return scored(spark, folder).select("user_id", "action_id", "session_id", "date", "reward", "success")


@query(
    "form_feedback_reward",
    """select user_id, turn, cast(coalesce(thumbs_up, false) as integer) + 0.5e0
         + 0.3e0 * (case when 1 + turn % 10 > 1 then (1 + turn % 10) / 10e0 else 1e0 end) as reward
       from form_feedback""",
    "form_feedback",
    "reward",
)
def form_feedback_reward(spark, folder):
    """Feedback as the app form sends it, normalised before the reward."""
    form = source(spark, folder, "form_feedback").select(
        "user_id",
        "turn",
        F.coalesce("thumbs_up", F.lit(False)).alias("completed"),
        (1 + F.col("turn") % 10).alias("satisfaction"),
    )
    return with_reward(normalise_form_feedback(form)).select("user_id", "turn", "reward")


@query("beta_posterior", "select * from posterior", "fb", "alpha beta total_reward", BETA)
def beta_posterior(spark, folder):
    return pt.beta_posterior(scored(spark, folder))


@query(
    "action_statistics",
    """select action_id, description, action_count, total_reward, alpha / (alpha + beta) as expected_reward
       from posterior join actions using (action_id)""",
    "fb",
    "total_reward expected_reward",
    BETA,
)
def action_statistics(spark, folder):
    return pt.action_statistics(pt.beta_posterior(scored(spark, folder)))


@query(
    "posterior_as_of_day",
    """select action_id, date, 1e0 + coalesce(sum(s) over w, 0) as alpha, 1e0 + coalesce(sum(n - s) over w, 0) as beta,
       cast(coalesce(sum(n) over w, 0) as bigint) as prior_count, coalesce(sum(r) over w, 0e0) as prior_reward
       from (select action_id, date, count(*) as n, count(*) filter (reward > 0.5) as s, sum(reward) as r
             from scored group by action_id, date) d
       window w as (partition by action_id order by date rows between unbounded preceding and 1 preceding)""",
    "fb",
    "alpha beta prior_reward",
    {"scored": SCORED},
)
def posterior_as_of_day(spark, folder):
    return pt.posterior_as_of_day(scored(spark, folder))


@query(
    "feedback_with_session",
    """select f.user_id, f.session_id, f.action_id, f.date, o_orderpriority as workout_type, c_mktsegment as segment
       from fb f join orders o on f.session_id = o.o_orderkey join customer c on f.user_id = c.c_custkey""",
    "fb",
)
def feedback_with_session(spark, folder):
    """Feedback with its session and user. Each key is unique on the parent side."""
    sessions = source(spark, folder, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("workout_type")
    )
    users = source(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")
    )
    feedback = source(spark, folder, "fb").select("user_id", "session_id", "action_id", "date")
    return feedback.join(sessions, "session_id").join(users, "user_id")


@query(
    "orphan_feedback",
    """select session_id, user_id, action_id from fb
       where session_id not in (select o_orderkey from orders where o_orderstatus <> 'P')""",
    "fb",
)
def orphan_feedback(spark, folder):
    """Feedback whose session is not among the closed ones."""
    closed = source(spark, folder, "orders").where(F.col("o_orderstatus") != "P")
    feedback = source(spark, folder, "fb").select("session_id", "user_id", "action_id")
    return orphans(feedback, closed.withColumnRenamed("o_orderkey", "session_id"), "session_id")


REFERENCE = """case when readiness_score >= 70 and fatigue <= 4 then 8 when readiness_score >= 55 and fatigue <= 6 then 13
  when readiness_score >= 40 then 4 when readiness_score >= 30 then 1 else 0 end"""


@query("reference_policy", f"select user_id, date, {REFERENCE} as action_id from states", "states")
def reference_policy(spark, folder):
    return source(spark, folder, "states").select("user_id", "date", ev.reference_policy().alias("action_id"))


@query(
    "intensity_mismatch",
    """select user_id, date, ideal_intensity, abs(intensity_rank - ideal_intensity) as mismatch, overtraining,
       0.8e0 - 0.25e0 * abs(intensity_rank - ideal_intensity) - case when overtraining then 0.5e0 else 0e0 end as base_score
       from (select d.*, a.intensity_rank, case when readiness_score >= 70 and fatigue <= 4 then 3
               when readiness_score >= 55 and fatigue <= 6 then 2 when readiness_score >= 40 then 1 else 0 end as ideal_intensity,
               a.intensity_rank = 3 and (fatigue > 7 or readiness_score < 40) as overtraining
             from decisions d join actions a using (action_id)) x""",
    "decisions",
    "base_score",
    {"actions": ACTIONS},
)
def intensity_mismatch(spark, folder):
    served = ev.with_intensity_mismatch(decorate(source(spark, folder, "decisions")))
    return served.select("user_id", "date", "ideal_intensity", "mismatch", "overtraining", "base_score")


METRICS = """select policy, avg(reward) as mean_reward, stddev_pop(reward) as std_reward, sum(reward) as cumulative_reward,
  avg(cast(action_id = optimal_action_id as integer)) as optimal_action_rate,
  avg(cast(is_overtraining as integer)) as overtraining_rate,
  avg(reward) filter (episode < n // 2) as first_half_mean_reward,
  avg(reward) filter (episode >= n // 2) as second_half_mean_reward,
  avg(reward) filter (episode >= n // 2) - avg(reward) filter (episode < n // 2) as learning_improvement
from (select *, count(*) over (partition by policy) as n from episodes) e group by policy"""


@query(
    "policy_metrics",
    METRICS,
    "episodes",
    "mean_reward std_reward cumulative_reward optimal_action_rate overtraining_rate first_half_mean_reward "
    "second_half_mean_reward learning_improvement",
)
def policy_metrics(spark, folder):
    return ev.policy_metrics(source(spark, folder, "episodes"))


@query(
    "policy_uplift",
    """select m.policy, m.mean_reward, (m.mean_reward - c.mean_reward) / greatest(abs(c.mean_reward), 1e-9) * 100 as uplift_vs_click_pct,
       (m.mean_reward - v.mean_reward) / greatest(abs(v.mean_reward), 1e-9) * 100 as uplift_vs_view_pct
       from metrics m, metrics c, metrics v where c.policy = 'click' and v.policy = 'view'""",
    "episodes",
    "mean_reward uplift_vs_click_pct uplift_vs_view_pct",
    {"metrics": METRICS},
)
def policy_uplift(spark, folder):
    return ev.policy_uplift(ev.policy_metrics(source(spark, folder, "episodes")), ["click", "view"])


ROLLING = """select policy, episode, reward, count(*) over (partition by policy) as n,
  avg(reward) over (partition by policy order by episode rows between 49 preceding and current row) as rolling_reward
from episodes"""


@query(
    "rolling_reward",
    "select policy, episode, reward, rolling_reward from rolled",
    "episodes",
    "reward rolling_reward",
    {"rolled": ROLLING},
)
def rolling_reward(spark, folder):
    return ev.rolling_reward(source(spark, folder, "episodes"))


@query(
    "convergence_episode",
    """select policy, any_value(target) as target, cast(coalesce(min(episode) filter (episode > 50 and rolling_reward >= target),
       any_value(n)) as bigint) as convergence_episode
       from rolled join (select policy, quantile_cont(rolling_reward, 0.25) as target from rolled
                         where episode >= n - 100 group by policy) t using (policy) group by policy""",
    "episodes",
    "target",
    {"rolled": ROLLING},
)
def convergence_episode(spark, folder):
    return ev.convergence_episode(source(spark, folder, "episodes"))
