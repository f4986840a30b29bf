"""Queries over sources and sinks: files are written from the tables, then read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.scalars import to_instant, wall_clock_date
from pulseframe.operators import features as ft
from pulseframe.operators import quality as ql
from pulseframe.operators.catalog import decorate
from pulseframe.operators.history import flatten_history, nest_history
from pulseframe.operators.posterior import beta_posterior, rejected_feedback
from pulseframe.operators.reward import with_reward
from pulseframe.plans.inputs import source
from pulseframe.plans.oracle_parts import ACTIONS, FEATURE_DOUBLES, FEATURE_SQL, HISTORY, POSTERIOR
from pulseframe.plans.registry import query
from pulseframe.session import scratch_path
from pulseframe.sources import files, health_xml, oura, sinks

_landed: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, folder: str, label: str, write) -> str:
    """Path of files written once per application and folder for ``label``."""
    key = (spark.sparkContext.applicationId, folder, label)
    if key not in _landed:
        path = scratch_path(spark, label)
        write(path)
        _landed[key] = path
    return _landed[key]


def export_path(spark: SparkSession, folder: str) -> str:
    """HealthKit XML of every event; some records carry a child element."""

    def write(path: str) -> None:
        e = source(spark, folder, "export")
        stamp = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.col("zone"))
        note = F.struct(F.lit("k").alias("_key"), F.col("k").cast("string").alias("_value"))
        e.select(
            F.col("hk_type").alias("_type"),
            F.col("source").alias("_sourceName"),
            stamp("start_local").alias("_startDate"),
            stamp("end_local").alias("_endDate"),
            F.col("value_text").alias("_value"),
            F.when(F.col("k") % 7 == 0, note).alias("MetadataEntry"),
        ).write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").save(path)

    return landed(spark, folder, "export-xml", write)


def health_records(spark: SparkSession, folder: str) -> DataFrame:
    return health_xml.scan_health_xml(spark, export_path(spark, folder))


STAMPS = """select *, substr(cast(start_local as string), 1, 19) || zone as start_text,
  substr(cast(end_local as string), 1, 19) || zone as end_text from export"""


@query(
    "scan_health_xml",
    """select type, hk_type as original_type, value_text as value, start_text as start_date,
       end_text as end_date, source from stamped""",
    "export",
    extra={"stamped": STAMPS},
)
def scan_health_xml(spark, folder):
    return health_records(spark, folder)


def _valued_view(name: str, view: str, types: str) -> None:
    sql = f"""select type, source, number as value, cast(floor(epoch(start_ts)) as bigint) as start_seconds,
      cast(start_local as date) as date from export where type in ({types})"""

    @query(name, sql, "export", "value")
    def build(spark, folder):
        records = health_xml.typed_view(health_records(spark, folder), view)
        seconds = F.unix_seconds("start_date").alias("start_seconds")
        return records.select("type", "source", "value", seconds, "date")


_valued_view("records_heart_rate", "heart_rate", "'heart_rate', 'resting_heart_rate'")
_valued_view("records_activity", "activity", "'steps', 'active_energy', 'basal_energy'")
_valued_view("records_hrv", "hrv", "'hrv'")


def _timed_view(name: str, view: str, kind: str, seconds_per_unit: int) -> None:
    sql = f"""select type, source, (floor(epoch(end_ts)) - floor(epoch(start_ts))) / {seconds_per_unit}e0 as duration,
      cast(start_local as date) as date from export where type = '{kind}'"""

    @query(name, sql, "export", "duration")
    def build(spark, folder):
        return health_xml.typed_view(health_records(spark, folder), view).select("type", "source", "duration", "date")


_timed_view("records_sleep", "sleep", "sleep", 3600)
_timed_view("records_workout", "workouts", "workout", 60)


@query(
    "local_dates",
    """select source, start_text as start_date, cast(start_local as date) as date,
       cast(start_ts as date) as utc_date from stamped""",
    "export",
    extra={"stamped": STAMPS},
)
def local_dates(spark, folder):
    utc = F.to_date(to_instant("start_date"))
    return health_records(spark, folder).select(
        "source", "start_date", wall_clock_date("start_date").alias("date"), utc.alias("utc_date")
    )


TRENDS = {
    "readiness_score": "Readiness Score",
    "hrv": "Average HRV",
    "resting_hr": "Average Resting Heart Rate",
    "sleep_duration_hours": "Total Sleep Duration",
    "steps": "Steps",
    "active_calories": "Activity Burn",
}


@query(
    "scan_oura_trends",
    """select user_id, date, readiness_score, hrv, resting_hr, sleep_duration_hours, steps, active_calories from oura_day""",
    "oura_day",
    "readiness_score hrv resting_hr sleep_duration_hours steps active_calories",
)
def scan_oura_trends(spark, folder):
    """Two sets of files with all values of their days: one has its columns in another order, and none
    for the night reading, which its days lack."""
    day = source(spark, folder, "oura_day").withColumnsRenamed(TRENDS)
    nights = day.where(F.col("Average HRV").isNotNull())
    others = day.where(F.col("Average HRV").isNull()).drop("Average HRV")
    others = others.select(*reversed(others.columns))
    paths = [
        landed(spark, folder, "trends-nights", lambda p: sinks.write_csv(nights, p)),
        landed(spark, folder, "trends-others", lambda p: sinks.write_csv(others, p)),
    ]
    trends = oura.scan_oura_trends(spark, paths)
    return trends.withColumn("user_id", F.col("user_id").cast("bigint"))


BROKEN = """select 'health_xml' as source, 'unreadable record' as reason, count(*) as row_count from export where k % 17 = 0
  union all select 'feedback', reason, count(*) from (select case when action is null then 'no action'
      when action not between 0 and 17 then 'unknown action' end as reason
    from (select case when n % 20 <> 3 then n % 20 - 1 end as action from fb_events) a) r where reason is not null group by reason"""


@query("rejected_rows", BROKEN, "export fb_events")
def rejected_rows(spark, folder):
    """What readers and statistics leave out, by source and reason: records whose tag can't be read
    and feedback on no known action. States that break rules are counted by ``quarantine_counts``."""

    def write(path: str) -> None:
        # Every 17th record has a value without quotes, as a broken export might.
        e = source(spark, folder, "export")
        value = F.when(F.col("k") % 17 == 0, F.lit("value=3 ")).otherwise(F.lit('value="3" '))
        tag = F.concat(F.lit('<Record type="'), "hk_type", F.lit('" '), value, F.lit('sourceName="'), "source", F.lit('"/>'))
        e.select(tag.alias("value")).write.text(path)

    xml = health_xml.quarantined_records(spark, landed(spark, folder, "export-broken", write))
    xml = xml.select(F.lit("health_xml").alias("source"), F.lit("unreadable record").alias("reason"))
    action = F.when(F.col("n") % 20 != 3, F.col("n") % 20 - 1)
    feedback = rejected_feedback(source(spark, folder, "fb_events").withColumn("action_id", action))
    feedback = feedback.select(F.lit("feedback").alias("source"), "reason")
    return xml.unionByName(feedback).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("row_count"))


def _payload(name: str, kind: str, fields: dict[str, str], select: str, doubles: str) -> None:
    """``fields`` maps payload fields to expressions over the daily rows."""

    @query(name, f"select cast(user_id as varchar) as user_id, {select} from oura_day", "oura_day", doubles)
    def build(spark, folder):
        def write(path: str) -> None:
            # One document per user and month, so at most 31 entries each.
            day = source(spark, folder, "oura_day")
            entry = F.struct(*[F.expr(sql).alias(field) for field, sql in fields.items()])
            documents = day.groupBy(F.col("user_id").cast("string"), F.trunc("date", "month").alias("m")).agg(
                F.collect_list(entry).alias("data")
            )
            documents.select("user_id", "data").write.json(path)

        path = landed(spark, folder, f"payload-{kind}", write)
        return oura.scan_oura_payloads(spark, path, kind, keep=("user_id",))


_payload(
    "flatten_oura_payload",
    "sleep",
    {
        "day": "cast(date as string)",
        "score": "readiness_score",
        "total_sleep_duration": "sleep_duration_hours * 3600",
        "deep_sleep_duration": "sleep_duration_hours * 900",
        "rem_sleep_duration": "sleep_duration_hours * 600",
        "light_sleep_duration": "sleep_duration_hours * 2100",
        "efficiency": "readiness_score / 2",
        "resting_heart_rate": "resting_hr",
        "hrv": "hrv",
        "sleep_latency": "hrv * 3",
        "awake_time": "hrv * 5",
    },
    """cast(date as varchar) as date, readiness_score as sleep_score,
       sleep_duration_hours * 3600 as total_sleep_duration, sleep_duration_hours * 900 as deep_sleep_duration,
       sleep_duration_hours * 600 as rem_sleep_duration, sleep_duration_hours * 2100 as light_sleep_duration,
       readiness_score / 2 as sleep_efficiency, resting_hr as resting_heart_rate, hrv,
       hrv * 3 as sleep_onset_latency, hrv * 5 as awake_time""",
    "sleep_score total_sleep_duration deep_sleep_duration rem_sleep_duration light_sleep_duration "
    "sleep_efficiency resting_heart_rate hrv sleep_onset_latency awake_time",
)
_payload(
    "flatten_oura_activity",
    "activity",
    {
        "day": "cast(date as string)",
        "steps": "steps",
        "calories_total": "active_calories + 1500",
        "calories_active": "active_calories",
        "score": "readiness_score",
        "met_minutes": "steps / 10",
        "low_activity_time": "steps / 20",
        "medium_activity_time": "steps / 30",
        "high_activity_time": "steps / 40",
    },
    """cast(date as varchar) as date, steps, active_calories + 1500 as calories_total,
       active_calories as calories_active, readiness_score as activity_score, steps / 10 as met_minutes,
       steps / 20 as low_activity_time, steps / 30 as medium_activity_time, steps / 40 as high_activity_time""",
    "steps calories_total calories_active activity_score met_minutes low_activity_time medium_activity_time "
    "high_activity_time",
)
_payload(
    "flatten_oura_readiness",
    "readiness",
    {
        "day": "cast(date as string)",
        "score": "readiness_score",
        "temperature_trend": "readiness_score / 100 - 0.5e0",
        "hrv_balance": "hrv / 2",
        "recovery_index": "readiness_score / 3",
        "resting_heart_rate": "resting_hr",
    },
    """cast(date as varchar) as date, readiness_score, readiness_score / 100 - 0.5e0 as temperature_trend,
       hrv / 2 as hrv_balance, readiness_score / 3 as recovery_index, resting_hr as resting_heart_rate""",
    "readiness_score temperature_trend hrv_balance recovery_index resting_heart_rate",
)


@query(
    "flatten_oura_heart_rate",
    """select substr(cast(ts as varchar), 1, 19) as timestamp, value as bpm, concat('ring-', user_id) as source
       from records where type = 'heart_rate'""",
    "records",
    "bpm",
)
def flatten_oura_heart_rate(spark, folder):
    def write(path: str) -> None:
        beats = source(spark, folder, "records").where(F.col("type") == "heart_rate")
        entry = F.struct(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
            F.col("value").alias("bpm"),
            F.concat(F.lit("ring-"), F.col("user_id").cast("string")).alias("source"),
        )
        beats.select(F.array(entry).alias("data")).write.json(path)

    path = landed(spark, folder, "payload-heart-rate", write)
    return oura.scan_oura_payloads(spark, path, "heart_rate")


@query(
    "scan_participants",
    """select substr(cast(ts as varchar), 1, 19) as timestamp, value as overall_score,
       'p=' || lpad(cast(user_id % 16 as varchar), 2, '0') as user_id, date
       from records where type = 'sleep'""",
    "records",
    "overall_score",
)
def scan_participants(spark, folder):
    """Sixteen participant folders, and one beside them that must not be read."""

    def write(path: str) -> None:
        nights = source(spark, folder, "records").where(F.col("type") == "sleep")
        scores = nights.select(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
            F.col("value").alias("overall_score"),
            F.lpad((F.col("user_id") % 16).cast("string"), 2, "0").alias("p"),
            F.lit(1).alias("fitbit"),
        )
        scores.write.partitionBy("p", "fitbit").option("header", True).csv(path)
        scores.drop("p", "fitbit").write.option("header", True).csv(f"{path}/other/fitbit=1")

    return files.scan_participants(spark, landed(spark, folder, "participants", write), "fitbit=1/*.csv")


@query(
    "scan_training_log",
    """select user_id, cast(date as date) as date, exercise_name, sets, reps, weight_kg, 30 + 5 * rpe as rest_seconds,
       rpe, fatigue, motivation, muscle_soreness, concat('set of ', sets) as notes, workout_type,
       total_duration_minutes from sessions""",
    "sessions",
    "weight_kg",
)
def scan_training_log(spark, folder):
    def write(path: str) -> None:
        log = source(spark, folder, "sessions").withColumns(
            {"rest_seconds": 30 + 5 * F.col("rpe"), "notes": F.concat(F.lit("set of "), F.col("sets").cast("string"))}
        )
        names = [c.split()[0] for c in files.TRAINING_LOG.split(", ")]
        sinks.write_csv(log.select("user_id", *names), path)

    log = files.scan_training_log(spark, landed(spark, folder, "training-log", write), "user_id bigint")
    return log.withColumn("date", F.to_date("date"))


@query(
    "import_history_csv",
    """select user_id, date, cast(trunc(readiness_score) as integer) as readiness_score,
       cast(trunc(sleep_score) as integer) as sleep_score, cast(trunc(hrv) as integer) as hrv,
       cast(trunc(resting_hr) as integer) as resting_hr, cast(trunc(activity_score) as integer) as activity_score,
       5 as fatigue, 'Unknown' as workout_type, 'csv_upload' as source from states""",
    "states",
)
def import_history_csv(spark, folder):
    """The upload lacks fatigue and workout type."""
    day = source(spark, folder, "states")
    columns = ["user_id", "date", "readiness_score", "sleep_score", "hrv", "resting_hr", "activity_score"]
    path = landed(spark, folder, "history-csv", lambda p: sinks.write_csv(day.select(columns), p))
    read = files.import_history_csv(spark, path, keep=("user_id", "date"))
    return read.withColumns({"user_id": F.col("user_id").cast("bigint"), "date": F.to_date("date")})


@query(
    "import_history_json",
    """select user_id, date, fatigue, cast(null as integer) as mood, 'Pending' as workout_type from states
       union all select user_id, date, fatigue, mood, cast(null as varchar) as workout_type from states""",
    "states",
)
def import_history_json(spark, folder):
    """Two uploads with different fields, aligned by name."""
    day = source(spark, folder, "states")
    flat = day.select("user_id", "date", "fatigue", F.lit("Pending").alias("workout_type"))
    with_mood = day.select("user_id", "date", "fatigue", "mood")
    first = landed(spark, folder, "history-json-a", lambda p: sinks.write_json(flat, p))
    second = landed(spark, folder, "history-json-b", lambda p: sinks.write_json(with_mood, p))
    a = files.import_history_json(spark, first, "user_id bigint, date date, fatigue int, workout_type string")
    b = files.import_history_json(spark, second, "user_id bigint, date date, fatigue int, mood int")
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "rows_per_file",
    """select 'events.parquet' as file, count(*) as row_count from events
       union all select 'lineitem.parquet', count(*) from lineitem
       union all select 'orders.parquet', count(*) from orders""",
)
def rows_per_file(spark, folder):
    """Counts of every file of three tables."""
    events, lines, orders = (ql.rows_per_file(source(spark, folder, n)) for n in ("events", "lineitem", "orders"))
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    return events.union(lines).union(orders).select(file, "row_count")


@query("features_roundtrip", FEATURE_SQL, "day", FEATURE_DOUBLES)
def features_roundtrip(spark, folder):
    def write(path: str) -> None:
        sinks.write_monthly(ft.daily_features(source(spark, folder, "day")), path)

    return spark.read.parquet(landed(spark, folder, "features", write)).drop("year_month")


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions as nested history documents, stamped at noon."""
    served = decorate(source(spark, folder, "decisions"))
    noon = F.col("date").cast("timestamp") + F.expr("interval '12' hour")
    return nest_history(served.withColumn("timestamp", noon))


FLAT_DOUBLES = "readiness sleep hrv rhr fatigue activity mood stress"


@query(
    "export_history_csv",
    """select user_id, date_str, workout, intensity, duration, readiness, sleep, hrv0 as hrv, rhr, fatigue, activity,
       mood, stress from flat""",
    "decisions",
    FLAT_DOUBLES,
    {"actions": ACTIONS, "flat": HISTORY},
)
def export_history_csv(spark, folder):
    flat = flatten_history(history(spark, folder)).drop("timestamp")
    path = landed(spark, folder, "export-csv", lambda p: sinks.write_csv(flat, p))
    return spark.read.schema(flat.schema).option("header", True).csv(path)


@query(
    "export_history_json",
    """select user_id, cast(timestamp as date) as date, workout as workout_type, intensity,
       duration as duration_minutes, readiness_score, hrv_raw as hrv from flat""",
    "decisions",
    "readiness_score hrv",
    {"actions": ACTIONS, "flat": HISTORY},
)
def export_history_json(spark, folder):
    documents = history(spark, folder)
    path = landed(spark, folder, "export-json", lambda p: sinks.write_json(documents, p))
    read = spark.read.schema(documents.schema).json(path)
    return read.select(
        "user_id", F.to_date("timestamp").alias("date"), "recommendation.*", "state.readiness_score", "state.hrv"
    )


@query(
    "explode_sessions",
    """select o_custkey as user_id, l_orderkey as session_id, cast(1 + o_orderkey % 10 as integer) as fatigue,
         u.exercise_name, u.sets, u.reps, u.weight_kg, 60 as rest_seconds
       from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey,
         unnest([{'exercise_name': p_name, 'sets': l_linenumber, 'reps': 0, 'weight_kg': l_quantity},
                 {'exercise_name': p_brand, 'sets': 0, 'reps': p_size, 'weight_kg': 0e0},
                 {'exercise_name': p_type, 'sets': l_linenumber, 'reps': p_size, 'weight_kg': l_quantity / 2}]
               ) as t(u)""",
    "",
    "weight_kg",
)
def explode_sessions(spark, folder):
    """Sessions of three exercises each; some fields are missing and take their defaults."""
    base = source(spark, folder, "lineitem").join(
        source(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(source(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    entry = lambda name, sets, reps, weight: F.struct(
        F.col(name).alias("exercise_name"),
        F.expr(sets).cast("int").alias("sets"),
        F.expr(reps).cast("int").alias("reps"),
        F.expr(weight).cast("double").alias("weight_kg"),
    )
    sessions = base.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_orderkey").alias("session_id"),
        (1 + F.col("o_orderkey") % 10).cast("int").alias("fatigue"),
        F.array(
            entry("p_name", "l_linenumber", "null", "l_quantity"),
            entry("p_brand", "null", "p_size", "null"),
            entry("p_type", "l_linenumber", "p_size", "l_quantity / 2"),
        ).alias("exercises"),
    )
    path = landed(spark, folder, "session-log", lambda p: sinks.append_sessions(sessions, p))
    return spark.read.parquet(path)


ROUTES = """select case event_type when 'view' then 'training.plan.adjusted' when 'click' then 'agent.user.feedback'
    when 'purchase' then 'agent.daily_summary' when 'error' then 'agent.micro_goal.set'
    else 'feedback_received' end as event_type, user_id, event_id,
    substr(cast(ts as string), 1, 19) as timestamp, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k
  from {events}"""

ROUTED_SQL = """select case event_type when 'training.plan.adjusted' then 'training.plan.served'
    when 'agent.user.feedback' then 'training.user.feedback' else 'agent.conversation.events' end as topic,
  case when event_type like '%feedback%' then 'training.user.feedback' else 'training.plan.served' end as loop_topic,
  cast(to_json({'event_type': event_type, 'user_id': user_id, 'timestamp': timestamp,
                'payload': {'event_id': event_id, 'k': k}}) as varchar) as value from coach_events"""
ROUTED_EXTRA = {"coach_events": ROUTES.format(events="events")}


def coach_events(events: DataFrame) -> DataFrame:
    """Events under the agent's type names with a payload."""
    renamed = F.expr(
        "case event_type when 'view' then 'training.plan.adjusted' when 'click' then 'agent.user.feedback' "
        "when 'purchase' then 'agent.daily_summary' when 'error' then 'agent.micro_goal.set' "
        "else 'feedback_received' end"
    )
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return events.select(
        renamed.alias("event_type"),
        "user_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.struct("event_id", k.alias("k")).alias("payload"),
    )


@query("route_events", ROUTED_SQL, extra=ROUTED_EXTRA)
def route_events(spark, folder):
    return sinks.route_events(coach_events(source(spark, folder, "events")))


@query(
    "posterior_snapshot",
    "select *, date '1999-12-31' as as_of from posterior",
    "fb",
    "alpha beta total_reward",
    {"actions": ACTIONS, **POSTERIOR},
)
def posterior_snapshot(spark, folder):
    """Two stored versions; the newest one is read back."""

    def write(path: str) -> None:
        scored = with_reward(source(spark, folder, "fb"))
        early = scored.where(F.col("date") < F.lit(dt.date(1998, 1, 1)))
        sinks.write_snapshot(beta_posterior(early), path, dt.date(1997, 12, 31))
        sinks.write_snapshot(beta_posterior(scored), path, dt.date(1999, 12, 31))

    return sinks.read_snapshot(spark, landed(spark, folder, "posterior", write))


@query(
    "daily_state_upsert",
    """select user_id, date, event_id as version, value as readiness_score from records
       qualify row_number() over (partition by user_id, date order by event_id desc) = 1""",
    "records",
    "readiness_score",
)
def daily_state_upsert(spark, folder):
    """Every record is a version of its day's state. The pulse records load first, then all of them."""
    records = source(spark, folder, "records")
    version = [F.col("event_id").alias("version"), F.col("value").alias("readiness_score")]
    pulse = records.where(F.col("type") == "heart_rate").select("user_id", "date", *version)
    everything = records.select("user_id", "date", *version)

    def write(path: str) -> None:
        sinks.upsert_states(pulse, path, "version")
        sinks.upsert_states(everything, path, "version")

    return spark.read.parquet(landed(spark, folder, "states", write))
