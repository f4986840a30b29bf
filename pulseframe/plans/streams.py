"""Queries that run a stream over the tables to its end and return what it wrote."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pulseframe.operators.policy import greedy, recommend
from pulseframe.operators.reward import with_reward
from pulseframe.plans.decisions import ALERT_SQL, CHECKED, GREEDY, beta, states_with_load
from pulseframe.plans.daily import MEASURE_DOUBLES, MEASURES
from pulseframe.plans.ingest import ROUTED_EXTRA, ROUTED_SQL, coach_events, landed
from pulseframe.plans.inputs import INPUTS, source
from pulseframe.plans.learning import BETA
from pulseframe.plans.oracle_parts import ACTIONS, POSTERIOR, SCORED
from pulseframe.plans.registry import ORACLES, query
from pulseframe.session import scratch_path
from pulseframe.streaming import jobs
from pulseframe.streaming.messages import feedback_messages, plan_messages
from pulseframe.streaming.runner import parquet_stream

#: Events of a delivered file, of all parts together on average, and of the smallest part.
EVENTS_PER_FILE = 1_000_000
LEAST_PER_FILE = 1000


def table_stream(spark, folder, name):
    return parquet_stream(spark, f"{folder}/{name}.parquet", source(spark, folder, name).schema)


def state_stream(spark, folder):
    """States land as a table that a stream then reads."""
    path = landed(spark, folder, "state-stream", lambda p: states_with_load(spark, folder).write.parquet(p))
    return parquet_stream(spark, path, spark.read.parquet(path).schema)


@query("stream_posterior", "select * from posterior", "fb", "alpha beta total_reward", BETA)
def stream_posterior(spark, folder):
    """Feedback lines stream in and are joined to the static session table."""
    lines = table_stream(spark, folder, "lineitem")
    feedback = spark.sql(INPUTS["fb"], lineitem=lines, orders=source(spark, folder, "orders"))
    return jobs.stream_posterior(feedback, scratch_path(spark, "stream-posterior"))


# What becomes of each delivered message: the newest good time before a part, less 30 days, parts
# late ones; of those left, the first of an event counts.
JUDGED = {
    "newest": """select p.arrival, max(d.date) as newest from (select distinct arrival from delivered) p
      join delivered d on d.arrival < p.arrival and d.fault is null group by p.arrival""",
    "timed": """select d.*, coalesce(fault, case when d.date < newest - interval 30 day then 'late' end) as early_reason
      from delivered d left join newest using (arrival)""",
    "judged": """select *, coalesce(early_reason, case when row_number() over (
        partition by event_id, early_reason is null order by arrival, copy) > 1 then 'repeated' end) as reason from timed""",
}
LEARNT = {"actions": ACTIONS, **JUDGED, **POSTERIOR, "scored": SCORED.replace("from fb", "from judged where reason is null")}


def delivered_messages(spark, folder, part: int):
    """The JSON messages that arrive with a part, some of them broken."""
    delivered = with_reward(source(spark, folder, "delivered")).where(F.col("arrival") == part)
    whole = F.col("value")
    broken = (
        F.when(F.col("fault") == "unreadable", F.expr("substr(value, 1, length(value) - 5)"))
        .when(F.col("fault") == "wrong type", F.regexp_replace(whole, '"action_id":[0-9]+', '"action_id":"x"'))
        .when(F.col("fault") == "unknown action", F.regexp_replace(whole, '"action_id":[0-9]+', '"action_id":99'))
        .when(F.col("fault") == "no event type", F.regexp_replace(whole, '"event_type":"[a-z_]+",', ""))
    )
    messages = feedback_messages(delivered, "date", keep=["fault"])
    return messages.select("topic", F.coalesce(broken, whole).alias("value"))


def learnt(spark, folder):
    """Posterior and rejected messages; both queries over them share the runs of the stream.

    Feedback lands in three parts, each written by as many tasks as it needs. The stream runs after
    each, so a part is one micro-batch however many files it has, and an empty one is a batch, too.
    """

    def run(path: str) -> None:
        topic = scratch_path(spark, "feedback-messages")
        for part in range(3):
            delivered_messages(spark, folder, part).write.mode("append").parquet(topic)
            jobs.stream_feedback(parquet_stream(spark, topic, spark.read.parquet(topic).schema), path)

    return jobs.feedback_results(spark, landed(spark, folder, "learnt", run), ["topic", "value"])


@query("stream_feedback_messages", "select * from posterior", "delivered", "alpha beta total_reward", LEARNT)
def stream_feedback_messages(spark, folder):
    """The posterior from messages of which some are broken, late or repeated."""
    return learnt(spark, folder)[0]


@query(
    "stream_dead_letters",
    "select arrival as batch_id, reason, count(*) as row_count from judged where reason is not null group by all",
    "delivered",
    extra=JUDGED,
)
def stream_dead_letters(spark, folder):
    """How many messages of each micro-batch couldn't be learnt from, and why."""
    rejected = learnt(spark, folder)[1]
    counts = rejected.groupBy("batch_id", "reason").agg(F.count(F.lit(1)).alias("row_count"))
    return counts.withColumn("batch_id", F.col("batch_id").cast("int"))


@query(
    "plan_messages",
    """select 'training.plan.served' as topic, cast(to_json({'event_type': 'plan_served', 'user_id': cast(user_id as varchar),
         'timestamp': cast(date as varchar), 'action_id': action_id, 'recommendation': {'action_id': action_id,
         'workout_type': workout_type, 'intensity': intensity, 'duration_minutes': duration_minutes,
         'description': description}}) as varchar) as value
       from greedy join actions using (action_id)""",
    "states fb",
    extra=GREEDY,
)
def plan_messages_of_states(spark, folder):
    posterior = beta(spark, folder)
    plans = recommend(states_with_load(spark, folder), lambda s: greedy(s, posterior))
    served = plans.select(
        "user_id", "date", "action_id", "workout_type", "intensity", "duration_minutes", "description"
    )
    return plan_messages(served)


@query("stream_recommend")
def stream_recommend(spark, folder):
    def store(path: str) -> None:
        beta(spark, folder).write.parquet(f"{path}/batch_id=0")

    posterior = landed(spark, folder, "served-posterior", store)
    return jobs.stream_recommendations(state_stream(spark, folder), posterior, scratch_path(spark, "stream-recommend"))


ORACLES["stream_recommend"] = ORACLES["recommend"]


@query("stream_route", ROUTED_SQL, extra=ROUTED_EXTRA)
def stream_route(spark, folder):
    return jobs.stream_routes(coach_events(table_stream(spark, folder, "events")), scratch_path(spark, "stream-route"))


@query("stream_alerts", ALERT_SQL, "states", extra=CHECKED)
def stream_alerts(spark, folder):
    return jobs.stream_alerts(state_stream(spark, folder), scratch_path(spark, "stream-alerts"))


@query("stream_daily", MEASURES.format(t="records"), "records", MEASURE_DOUBLES)
def stream_daily(spark, folder):
    records = spark.sql(INPUTS["records"], events=table_stream(spark, folder, "events"))
    timed = records.drop("date").withColumns({"ts": F.col("ts").cast("timestamp"), "duration": F.col("value")})
    return jobs.stream_daily(timed, scratch_path(spark, "stream-daily"))


@query(
    "stream_daily_late",
    """select count(*) as late from events where event_id % 50 = 0
       and ts <= (select max(ts) from events where event_id % 2 = 1) - interval 1 day""",
)
def stream_daily_late(spark, folder):
    """Every fiftieth record arrives after all others; those of the last day still count. Rows of a
    micro-batch are held against the watermark of the batch before the last."""

    events = source(spark, folder, "events")
    parts = ["event_id % 2 = 1", "event_id % 2 = 0 AND event_id % 50 <> 0", "event_id % 50 = 0"]
    sizes = events.agg(*[F.count_if(F.expr(part)) for part in parts]).first()
    # As many files in each part, as a micro-batch takes so many; rows are dealt in turn, so none is empty.
    files = max(1, min(math.ceil(sum(sizes) / EVENTS_PER_FILE), min(sizes) // LEAST_PER_FILE))

    def deliver(path: str) -> None:
        for part in parts:
            events.where(part).repartition(files).write.mode("append").parquet(path)

    path = landed(spark, folder, "events-late", deliver)
    events = parquet_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=files)
    records = spark.sql(INPUTS["records"], events=events)
    timed = records.drop("date").withColumns({"ts": F.col("ts").cast("timestamp"), "duration": F.col("value")})
    out = scratch_path(spark, "stream-daily-late")
    jobs.stream_daily(timed, out)
    return jobs.late_records(spark, out)
