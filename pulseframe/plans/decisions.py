"""Queries over safety checks, allowed actions and action choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators import features as ft
from pulseframe.operators import policy as po
from pulseframe.operators import posterior as pt
from pulseframe.operators import safety as sf
from pulseframe.operators.catalog import decorate, resolve, within_limits
from pulseframe.operators.reward import with_reward
from pulseframe.plans.inputs import source
from pulseframe.plans.oracle_parts import (
    ACTIONS,
    ALLOWED_CODED,
    ALLOWED_DECLARED_LOAD,
    ALLOWED_MINIMAL,
    ASSESSED,
    LOAD_STATES,
    POSTERIOR,
    RATIONALE,
    RULE,
    SINCE_STATES,
)
from pulseframe.plans.registry import query

KEYS = ["user_id", "date"]
SEED = 42


def states(spark, folder):
    return source(spark, folder, "states")


def states_with_load(spark, folder):
    return ft.with_high_load_days(states(spark, folder))


def states_with_since(spark, folder):
    return ft.with_days_since_training(states(spark, folder))


def states_with_run(spark, folder):
    """States with days since training and the run of high-load days."""
    return ft.with_days_since_training(states_with_load(spark, folder))


def beta(spark, folder):
    return pt.beta_posterior(with_reward(source(spark, folder, "fb")))


def _listed(df):
    """Key columns and the allowed ids as text."""
    return df.select(*KEYS, F.array_join(F.col("allowed").cast("array<string>"), ",").alias("allowed"))


def allowed_text(expression: str) -> str:
    return f"select user_id, date, array_to_string({expression}, ',') as allowed from "


CHECKED = {"checked": "select * from states", "assessed": ASSESSED}


@query(
    "safety_assess",
    "select user_id, date, is_safe, risk_level, message, recommended_action from assessed",
    "states",
    extra=CHECKED,
)
def safety_assess(spark, folder):
    return sf.assess(states(spark, folder)).select(*KEYS, *sf.OUTCOME)


@query("allowed_actions_coded", allowed_text(ALLOWED_CODED) + "assessed", "states", extra=CHECKED)
def allowed_actions_coded(spark, folder):
    return _listed(sf.allowed_coded(sf.assess(states(spark, folder))))


@query(
    "allowed_actions_declared",
    allowed_text(ALLOWED_DECLARED_LOAD) + "load_states",
    "states",
    extra={"load_states": LOAD_STATES},
)
def allowed_actions_declared(spark, folder):
    return _listed(sf.allowed_declared(states_with_load(spark, folder)))


@query("allowed_actions_minimal", allowed_text(ALLOWED_MINIMAL) + "states", "states")
def allowed_actions_minimal(spark, folder):
    return _listed(sf.allowed_minimal(states(spark, folder)))


@query(
    "actions_within_limits",
    """select user_id, date, action_id from limited, actions
       where list_contains(types, workout_type) and intensity_rank <= top""",
    "states",
    extra={
        "actions": ACTIONS,
        "limited": """select user_id, date,
          case mood when 1 then ['REST'] when 2 then ['REST', 'RECOVERY'] when 3 then ['CARDIO']
            else ['REST', 'RECOVERY', 'STRENGTH', 'CARDIO'] end as types,
          case stress when 1 then 3 when 2 then 2 when 3 then 1 when 4 then 3 else 0 end as top from states""",
    },
)
def actions_within_limits(spark, folder):
    """Limits per row; one of the intensity names is unknown and allows every level."""
    words = lambda *names: F.array(*[F.lit(n) for n in names])
    types = (
        F.when(F.col("mood") == 1, words("REST"))
        .when(F.col("mood") == 2, words("REST", "RECOVERY"))
        .when(F.col("mood") == 3, words("CARDIO"))
        .otherwise(words("REST", "RECOVERY", "STRENGTH", "CARDIO"))
    )
    top = F.element_at(words("HIGH", "MEDIUM", "LOW", "EXTREME", "NONE"), F.col("stress"))
    ids = within_limits(F.col("types"), F.col("top"))
    limited = states(spark, folder).select(*KEYS, types.alias("types"), top.alias("top"))
    return limited.select(*KEYS, F.explode(ids).alias("action_id"))


PLAN_SQL = """select p.session_id, p.user_id, intensity, fatigue,
  not (hard or name is not null) as is_safe,
  case when hard then 'high' when name is not null then 'critical' else 'low' end as risk_level,
  case when hard then 'High intensity plan requested but fatigue level is elevated'
    when name is not null then 'Plan includes exercise that may aggravate injury history: ' || name
    else 'Plan is safe given current state' end as message,
  case when hard then 'reduce_intensity' when name is not null then 'modify_plan' else 'proceed' end as recommended_action
from (select session_id, user_id, intensity, fatigue, intensity = 'high' and fatigue >= 7 as hard,
        arg_min(name, (position, name)) filter (hit) as name
      from (select *, lower(exercise_name) as name,
              case injury_case when 0 then contains(lower(exercise_name), 'ring')
                when 1 then contains(lower(exercise_name), 'bolt') or contains(lower(exercise_name), 'rod')
                else false end as hit from plans) x
      group by session_id, user_id, intensity, fatigue) p"""


def checked_plans(spark, folder):
    words = lambda *names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    case = F.col("injury_case")
    injuries = F.when(case == 0, words("RING")).when(case == 1, words("Bolt", "rod")).otherwise(words())
    exercises = source(spark, folder, "plans").withColumn("injuries", injuries)
    return sf.plan_safety(exercises, ["session_id", "user_id"])


@query("plan_safety", PLAN_SQL, "plans")
def plan_safety(spark, folder):
    return checked_plans(spark, folder).drop("injuries")


@query(
    "plan_adjust",
    """select user_id, date, case when recommended_action = 'rest_day_or_light_activity' then 'low'
         when recommended_action = 'reduce_intensity' then case intensity when 'high' then 'moderate'
           when 'moderate' then 'low' else intensity end else intensity end as intensity,
       case when recommended_action = 'rest_day_or_light_activity' then 'low' else 'moderate' end as volume
       from (select *, case mood % 3 when 0 then 'low' when 1 then 'moderate' else 'high' end as intensity from assessed) a""",
    "states",
    extra=CHECKED,
)
def plan_adjust(spark, folder):
    level = F.when(F.col("mood") % 3 == 0, "low").when(F.col("mood") % 3 == 1, "moderate").otherwise("high")
    plans = sf.assess(states(spark, folder)).withColumns({"intensity": level, "volume": F.lit("moderate")})
    return sf.adjust_plan(plans).select(*KEYS, "intensity", "volume")


ALERT_SQL = """select 'safety_alert' as type, 'critical' as severity, user_id, date, message as reason,
  'stop_training_and_consult_professional' as recommended_action,
  '⚠️ SAFETY ALERT: ' || message || chr(10) || chr(10) ||
  'Please stop training and consult with a healthcare professional if you experience: ' ||
  'chest pain, dizziness, severe discomfort, or abnormal heart rate patterns.' as message
from assessed where not is_safe"""


@query("safety_alerts", ALERT_SQL, "states", extra=CHECKED)
def safety_alerts(spark, folder):
    return sf.safety_alerts(sf.assess(states(spark, folder)))


@query(
    "mood_class",
    """select user_id, date, case when mood <= 2 or stress >= 4 then 'gentle' when mood >= 4 then 'push'
       else 'neutral' end as response from states""",
    "states",
)
def mood_class(spark, folder):
    return states(spark, folder).select(*KEYS, sf.mood_class().alias("response"))


@query(
    "state_summary",
    """select user_id, date, coalesce(nullif(concat_ws('. ',
         case when readiness_score <> 0 then 'Readiness score: ' || cast(readiness_score as varchar) || '/100' end,
         case when sleep_score <> 0 then 'Sleep quality: ' || cast(sleep_score as varchar) || '/100' end,
         case when resting_hr <> 0 then 'Resting heart rate: ' || cast(resting_hr as varchar) || ' bpm' end,
         case when days_since_training is not null then 'Last trained ' || cast(days_since_training as varchar) || ' days ago' end,
         case when fatigue <> 0 then 'Fatigue level: ' || cast(fatigue as varchar) || '/10' end,
         case when mood <> 0 then 'Mood score: ' || cast(mood as varchar) || '/5' end), ''), 'No data available') as summary
       from since_states""",
    "states",
    extra={"since_states": SINCE_STATES},
)
def state_summary(spark, folder):
    df = states_with_since(spark, folder)
    return df.select(*KEYS, sf.state_summary(df.columns).alias("summary"))


@query(
    "nested_state",
    """select user_id, date, cast(to_json({'user_id': user_id, 'date': cast(date as varchar),
         'physiological': {'hrv': hrv, 'resting_hr': resting_hr, 'sleep_duration_hours': sleep_duration_hours,
           'sleep_score': sleep_score, 'readiness_score': readiness_score},
         'activity': {'steps': round(steps), 'active_calories': round(active_calories)},
         'training': {'days_since_training': days_since_training, 'training_frequency_last_week': null,
           'avg_rpe_last_week': null, 'completion_rate_last_week': null},
         'user_feedback': {'fatigue': fatigue, 'motivation': null, 'soreness': soreness, 'stress': stress, 'mood': mood},
         'goals': {'primary_goal': null, 'current_phase': null},
         'safety': {'injury_history': null, 'overtraining_risk': overtraining_risk}}) as varchar) as state
       from since_states""",
    "states",
    extra={"since_states": SINCE_STATES},
)
def nested_state(spark, folder):
    df = states_with_since(spark, folder).withColumns(
        {"steps": F.round("steps"), "active_calories": F.round("active_calories")}
    )
    return df.select(*KEYS, F.to_json(sf.nested_state(df), {"ignoreNullFields": "false"}).alias("state"))


@query(
    "json_state_fields",
    """select event_id, cast(json_extract(props, '$.k') as integer) as k, cast(json_extract(props, '$.k') as integer) % 10 + 1
       as fatigue from events""",
)
def json_state_fields(spark, folder):
    parsed = F.from_json("props", "k int").getField("k")
    again = F.get_json_object("props", "$.k").try_cast("int")
    return source(spark, folder, "events").select("event_id", parsed.alias("k"), (again % 10 + 1).alias("fatigue"))


@query(
    "context_vectors",
    """select user_id, date, coalesce(readiness_score, 50) / 100 as c0, coalesce(sleep_score, 50) / 100 as c1,
       coalesce(activity_score, 50) / 100 as c2, coalesce(hrv, 50) / 100 as c3, coalesce(resting_hr, 60) / 100 as c4,
       coalesce(fatigue, 5) / 10e0 as c5, coalesce(days_since_training, 1) / 7e0 as c6 from since_states""",
    "states",
    "c0 c1 c2 c3 c4 c5 c6",
    {"since_states": SINCE_STATES},
)
def context_vectors(spark, folder):
    vectors = states_with_since(spark, folder).select(*KEYS, pt.context_vector().alias("context"))
    return vectors.select(*KEYS, *[F.col("context")[i].alias(f"c{i}") for i in range(pt.CONTEXT_SIZE)])


RULED = {
    "since_states": SINCE_STATES,
    "load_states": LOAD_STATES,
    "open_states": f"""select s.*, {ALLOWED_DECLARED_LOAD} as allowed
      from since_states s join (select user_id, date, consecutive_high_days from load_states) l using (user_id, date)""",
    "ruled": f"select *, {RULE} as action_id from open_states",
}


@query("rule_policy", "select user_id, date, action_id from ruled", "states", extra=RULED)
def rule_policy(spark, folder):
    return po.rule_policy(sf.with_allowed(states_with_run(spark, folder))).select(*KEYS, "action_id")


@query(
    "rationale",
    f"select user_id, date, action_id, {RATIONALE} as rationale from ruled join actions using (action_id)",
    "states",
    extra={**RULED, "actions": ACTIONS},
)
def rationale(spark, folder):
    chosen = decorate(po.rule_policy(sf.with_allowed(states_with_run(spark, folder))))
    return chosen.select(*KEYS, "action_id", po.rationale().alias("rationale"))


@query(
    "resolve_action",
    """select user_id, date, workout_type, coalesce(a.action_id, 0) as action_id from wanted w
       left join actions a using (workout_type, intensity, duration_minutes)""",
    "states",
    extra={
        "actions": ACTIONS,
        "wanted": """select user_id, date, case mood when 1 then 'REST' when 2 then 'RECOVERY' when 3 then 'STRENGTH'
            when 4 then 'CARDIO' else 'YOGA' end as workout_type,
          case stress % 3 when 0 then 'LOW' when 1 then 'MEDIUM' else 'HIGH' end as intensity,
          15 * (1 + fatigue % 3) as duration_minutes from states""",
    },
)
def resolve_action(spark, folder):
    """Lookups by type, intensity and minutes, many of them without a match."""
    types = F.array(*[F.lit(t) for t in ("REST", "RECOVERY", "STRENGTH", "CARDIO", "YOGA")])
    levels = F.array(*[F.lit(t) for t in ("LOW", "MEDIUM", "HIGH")])
    wanted = states(spark, folder).select(
        *KEYS,
        F.element_at(types, F.col("mood")).alias("workout_type"),
        F.get(levels, F.col("stress") % 3).alias("intensity"),
        (15 * (1 + F.col("fatigue") % 3)).alias("duration_minutes"),
    )
    return resolve(wanted).select(*KEYS, "workout_type", "action_id")


@query(
    "candidate_actions",
    f"""select user_id, date, action_id, workout_type, intensity, duration_minutes, intensity_rank
        from (select user_id, date, unnest({ALLOWED_DECLARED_LOAD}) as action_id from load_states) s
        join actions using (action_id)""",
    "states",
    extra={"actions": ACTIONS, "load_states": LOAD_STATES},
)
def candidate_actions(spark, folder):
    candidates = po.candidate_actions(sf.with_allowed(states_with_load(spark, folder)).select(*KEYS, "allowed"))
    return candidates.drop("description")


@query(
    "decorate_decisions",
    """select user_id, date, action_id, reward, workout_type, intensity, duration_minutes, description
       from decisions join actions using (action_id)""",
    "decisions",
    "reward",
    {"actions": ACTIONS},
)
def decorate_decisions(spark, folder):
    served = decorate(source(spark, folder, "decisions").select(*KEYS, "action_id", "reward"))
    return served.drop("intensity_rank")


GREEDY = {
    "actions": ACTIONS,
    **POSTERIOR,
    "load_states": LOAD_STATES,
    "open_states": f"select *, {ALLOWED_DECLARED_LOAD} as allowed from load_states",
    "scored_actions": """select s.user_id, s.date, s.action_id, alpha / (alpha + beta) as mean
        from (select user_id, date, unnest(allowed) as action_id from open_states) s join posterior using (action_id)""",
    "greedy": """select user_id, date, action_id from scored_actions
        qualify row_number() over (partition by user_id, date order by mean desc, action_id) = 1""",
}


@query("greedy_decision", "select user_id, date, action_id from greedy", "states fb", extra=GREEDY)
def greedy_decision(spark, folder):
    opened = sf.with_allowed(states_with_load(spark, folder)).select(*KEYS, "allowed")
    return po.greedy(opened, beta(spark, folder)).drop("allowed")


@query(
    "action_shares",
    "select user_id, date, action_id, mean / sum(mean) over (partition by user_id, date) as share from scored_actions",
    "states fb",
    "share",
    GREEDY,
)
def action_shares(spark, folder):
    opened = sf.with_allowed(states_with_load(spark, folder)).select(*KEYS, "allowed")
    return pt.action_shares(opened, beta(spark, folder))


@query(
    "recommend",
    f"""select user_id, date, action_id, workout_type, intensity, duration_minutes, description, is_safe,
        message as safety_message, {RATIONALE} as rationale
        from assessed join greedy using (user_id, date) join actions using (action_id)""",
    "states fb",
    extra={**GREEDY, **CHECKED},
)
def recommend(spark, folder):
    posterior = beta(spark, folder)
    return po.recommend(states_with_load(spark, folder), lambda s: po.greedy(s, posterior))


def uniform_sql(n: str) -> str:
    """Number ``n`` of the state's digests, by user, date and the seed."""
    text = f"concat_ws('|', '{SEED}', cast(user_id as varchar), cast(date as varchar), cast(({n}) // 4 as varchar))"
    return f"(cast('0x' || substr(md5({text}), 1 + 8 * (({n}) % 4), 8) as ubigint) + 0.5e0) / 4294967296e0"


# Quantiles of each Beta posterior: its density is summed over 40,000 cells around the mean, and the
# sums are read at 1025 levels, the outer two a quarter step inside.
_STEPS = pt.GRID_STEPS
THOMPSON = {
    "reach": """select action_id, alpha, beta, greatest(0e0, mean - 12 * sd) as low, least(1e0, mean + 12 * sd) as high
      from (select *, alpha / (alpha + beta) as mean,
              sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) as sd from posterior) p""",
    "cells": """select action_id, i, alpha, beta, low + (high - low) * i / 40000 as x0, low + (high - low) * (i + 1) / 40000 as x1
      from reach, (select unnest(generate_series(0, 39999)) as i) s""",
    "logs": "select *, (alpha - 1) * ln((x0 + x1) / 2) + (beta - 1) * ln(1 - (x0 + x1) / 2) as log_density from cells",
    "masses": "select action_id, i, x0, x1, exp(log_density - max(log_density) over (partition by action_id)) as mass from logs",
    "sums": """select *, sum(mass) over (partition by action_id order by i rows unbounded preceding) as c,
      sum(mass) over (partition by action_id) as total from masses""",
    "below": "select action_id, x0, x1, (c - mass) / total as c0, mass / total as share from sums",
    "levels": f"""select action_id, j, case j when 0 then 0.25e0 / {_STEPS} when {_STEPS} then 1 - 0.25e0 / {_STEPS}
        else j / {_STEPS}e0 end as level
      from posterior, (select unnest(generate_series(0, {_STEPS})) as j) s""",
    "quantiles": """select l.action_id, list(x0 + (level - c0) / share * (x1 - x0) order by j) as grid
      from levels l asof join below b on l.action_id = b.action_id and l.level >= b.c0 group by l.action_id""",
    "places": f"""select user_id, date, action_id, ({uniform_sql('action_id')}) * {_STEPS} as place
      from (select user_id, date, unnest(allowed) as action_id from open_states) s""",
    "draws": """select user_id, date, action_id, grid[cast(floor(place) as integer) + 1]
        + (place - floor(place)) * (grid[cast(floor(place) as integer) + 2] - grid[cast(floor(place) as integer) + 1]) as draw
      from places join quantiles using (action_id)""",
}


@query(
    "thompson_decision",
    """select user_id, date, action_id from draws
       qualify row_number() over (partition by user_id, date order by draw desc, action_id) = 1""",
    "states fb",
    extra={**GREEDY, **THOMPSON},
)
def thompson_decision(spark, folder):
    opened = sf.with_allowed(states_with_load(spark, folder)).select(*KEYS, "allowed")
    return po.thompson(opened, beta(spark, folder), SEED, KEYS).drop("allowed")


def decisions_with_context(spark, folder):
    served = ft.with_days_since_training(source(spark, folder, "decisions"))
    return served.select(*KEYS, "action_id", "reward", pt.context_vector().alias("context"))


_PAIRS = pt.pair_names()
_N = pt.CONTEXT_SIZE
VECTORS = {
    "since_states": SINCE_STATES.replace("from states)", "from decisions)"),
    "vectors": """select user_id, date, action_id, reward, coalesce(readiness_score, 50) / 100 as c0,
      coalesce(sleep_score, 50) / 100 as c1, coalesce(activity_score, 50) / 100 as c2, coalesce(hrv, 50) / 100 as c3,
      coalesce(resting_hr, 60) / 100 as c4, coalesce(fatigue, 5) / 10e0 as c5,
      coalesce(days_since_training, 1) / 7e0 as c6 from since_states""",
}


def solved(inverse: bool = False) -> dict[str, str]:
    """Gauss-Jordan elimination of every action's system (B | f), one expression per pivot; with
    ``inverse`` of (B | f | I), which leaves the inverse of B in the columns after the solution."""
    width = 2 * _N + 1 if inverse else _N + 1
    cells = [(i, j) for i in range(_N) for j in range(width)]

    def first(i: int, j: int) -> str:
        if j < _N:
            return f"sum(c{i} * c{j}) + {int(i == j)}e0 as a_{i}_{j}"
        return f"sum(reward * c{i}) as a_{i}_{j}" if j == _N else f"{int(j - _N - 1 == i)}e0 as a_{i}_{j}"

    steps = {"step_0": f"select action_id, {', '.join(first(i, j) for i, j in cells)} from vectors group by action_id"}
    for k in range(_N):
        reduced = [
            f"a_{k}_{j} / a_{k}_{k} as a_{i}_{j}" if i == k else f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} as a_{i}_{j}"
            for i, j in cells
        ]
        steps[f"step_{k + 1}"] = f"select action_id, {', '.join(reduced)} from step_{k}"
    return steps


@query(
    "linear_expected_reward",
    f"""select user_id, date, action_id, reward, {" + ".join(f"a_{i}_{_N} * c{i}" for i in range(_N))} as expected_reward
        from vectors join step_{_N} using (action_id)""",
    "decisions",
    "reward expected_reward",
    {**VECTORS, **solved()},
)
def linear_expected_reward(spark, folder):
    served = decisions_with_context(spark, folder)
    linear = pt.linear_posterior(pt.linear_statistics(served))
    return pt.expected_reward(served, linear).drop("context")


@query(
    "linear_statistics",
    "select action_id, count(*) as action_count, "
    + ", ".join(f"sum(c{i} * c{j}) + {1 if i == j else 0}e0 as b_{i}_{j}" for i, j in _PAIRS)
    + ", "
    + ", ".join(f"sum(reward * c{i}) as f_{i}" for i in range(pt.CONTEXT_SIZE))
    + " from vectors group by action_id",
    "decisions",
    " ".join([f"b_{i}_{j}" for i, j in _PAIRS] + [f"f_{i}" for i in range(pt.CONTEXT_SIZE)]),
    VECTORS,
)
def linear_statistics(spark, folder):
    return pt.linear_statistics(decisions_with_context(spark, folder))


def _linear_draws() -> dict[str, str]:
    """The sampled reward of each allowed action: mean m'x and variance x'Cx of the linear posterior, or
    of the prior where an action was never served, and a normal number from two uniforms."""
    mean = " + ".join(f"coalesce(a_{i}_{_N}, 0e0) * c{i}" for i in range(_N))
    terms = [f"coalesce(a_{i}_{_N + 1 + j}, {int(i == j)}e0) * c{i} * c{j}" for i in range(_N) for j in range(_N)]
    normal = f"sqrt(-2 * ln({uniform_sql('2 * action_id')})) * cos(2 * pi() * ({uniform_sql('2 * action_id + 1')}))"
    return {
        "asked": """select user_id, date, unnest(allowed) as action_id, coalesce(readiness_score, 50) / 100 as c0,
          coalesce(sleep_score, 50) / 100 as c1, coalesce(activity_score, 50) / 100 as c2, coalesce(hrv, 50) / 100 as c3,
          coalesce(resting_hr, 60) / 100 as c4, coalesce(fatigue, 5) / 10e0 as c5,
          coalesce(days_since_training, 1) / 7e0 as c6 from open_states""",
        "linear_draws": f"""select user_id, date, action_id,
            {mean} + sqrt(greatest(0e0, {" + ".join(terms)})) * {normal} as draw
          from asked left join step_{_N} using (action_id)""",
    }


def _opened() -> dict[str, str]:
    """``open_states`` with days since training, beside the vectors of the decisions."""
    names = {k: v for k, v in RULED.items() if k != "ruled"}
    names["state_since"] = names.pop("since_states")
    names["open_states"] = names["open_states"].replace("since_states", "state_since")
    return {"load_states": names["load_states"], "state_since": names["state_since"], "open_states": names["open_states"]}


@query(
    "linear_thompson_decision",
    """select user_id, date, action_id from linear_draws
       qualify row_number() over (partition by user_id, date order by draw desc, action_id) = 1""",
    "states decisions",
    extra={**VECTORS, **solved(inverse=True), **_opened(), **_linear_draws()},
)
def linear_thompson_decision(spark, folder):
    linear = pt.linear_posterior(pt.linear_statistics(decisions_with_context(spark, folder)))
    opened = sf.with_allowed(states_with_run(spark, folder)).withColumn("context", pt.context_vector())
    return po.linear_thompson(opened.select(*KEYS, "allowed", "context"), linear, SEED, KEYS).select(*KEYS, "action_id")
