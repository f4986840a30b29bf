"""The streaming forms of posterior updates, recommendations, routing, alerts and daily sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.operators.daily import daily_measures
from pulseframe.operators.policy import greedy, recommend
from pulseframe.operators.posterior import beta_posterior
from pulseframe.operators.reward import with_reward
from pulseframe.operators.safety import assess, safety_alerts
from pulseframe.sources.sinks import route_events
from pulseframe.streaming.messages import LATE, REPEATED, judged_feedback
from pulseframe.streaming.runner import (
    append_available,
    batch_ids,
    batch_path,
    merge_batches,
    newest_batch,
    newest_only,
    newest_per_key,
    newest_rows,
    read_batches,
    run_batches,
    write_batches,
)


def _deduplicated(stream: DataFrame, event_id: str | None, time: str, delay: str) -> DataFrame:
    """Drop repeats of an event that arrive within the delay; transports deliver at least once."""
    if event_id is None:
        return stream
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([event_id])


def feedback_counts(
    feedback: DataFrame, event_id: str | None = None, time: str = "timestamp", delay: str = "1 day"
) -> DataFrame:
    """Running counts per action (18 keys of state)."""
    return _counted(with_reward(_deduplicated(feedback, event_id, time, delay)))


def _counted(scored: DataFrame) -> DataFrame:
    return scored.groupBy("action_id").agg(
        F.sum("success").alias("successes"),
        F.count(F.lit(1)).alias("action_count"),
        F.sum("reward").alias("total_reward"),
    )


def stream_posterior(feedback: DataFrame, path: str, **dedup: str) -> DataFrame:
    """Keep the Beta posterior up to date from a feedback stream and return its latest state.

    Every batch stores the whole posterior (18 rows), which is what recommendation jobs read.
    """
    counts = feedback_counts(feedback, **dedup)
    write_batches(counts, path, "complete", lambda batch, _: posterior_from_counts(batch), newest_only)
    return newest_batch(feedback.sparkSession, path)


def posterior_from_counts(counts: DataFrame) -> DataFrame:
    """Beta posterior from rows that already hold counts per action."""
    expanded = counts.select(
        "action_id",
        F.col("successes").alias("success"),
        F.col("total_reward").alias("reward"),
        F.col("action_count").alias("weight"),
    )
    return beta_posterior(expanded, weight="weight")


def _summed(counts: DataFrame) -> DataFrame:
    """Counts of several batches as those of the last."""
    added = [F.sum(name).alias(name) for name in ("successes", "action_count", "total_reward")]
    return counts.groupBy("action_id").agg(*added, F.max("batch_id").alias("batch_id"))


def _learnt(spark: SparkSession, path: str, batch_id: int, earliest: Column) -> DataFrame | None:
    """Event ids learnt from in earlier batches whose time is not before ``earliest``. Only batches that
    reach so far are read, by the last time that each has noted."""
    times = read_batches(spark, f"{path}-times", before=batch_id)
    reaching = times.where(F.col("last") >= earliest).select("learnt_in").collect() if times is not None else []
    if not reaching:
        return None
    rows = spark.read.parquet(*[batch_path(f"{path}-rows", r.learnt_in) for r in reaching])
    return rows.where(F.col("reason").isNull() & (F.col("time") >= earliest)).select("event_id")


def learn_batch(batch: DataFrame, batch_id: int, path: str, delay: str) -> None:
    """One micro-batch of messages: judge every one, then add what is good to the counts.

    Rows go to ``path-rows`` with the reason why they aren't learnt from, or null: ``late`` if
    older by ``delay`` than the newest of the batches before, ``repeated`` if their event is known
    within that delay. All of it depends on earlier batches alone, so a batch that runs again
    replaces its own folders by equal ones.
    """
    spark = batch.sparkSession
    known = read_batches(spark, f"{path}-times", before=batch_id)
    newest = known.select(F.max("last")).first()[0] if known is not None else None
    placed = batch.withColumn("__place", F.monotonically_increasing_id())
    judged = judged_feedback(placed).withColumns({"time": F.col("timestamp").try_cast("timestamp"), "__old": F.lit(False)})
    if newest is not None:
        earliest = F.lit(newest) - F.expr(f"INTERVAL {delay}")
        judged = judged.withColumn("reason", F.coalesce("reason", F.when(F.col("time") < earliest, F.lit(LATE))))
        learnt = _learnt(spark, path, batch_id, earliest)
        if learnt is not None:
            old = learnt.distinct().withColumn("__old", F.lit(True))
            judged = judged.unionByName(old, allowMissingColumns=True)
    # Only good rows compete for an event, which an earlier batch may have; those without an id, as
    # well as the rejected, stand alone. All are judged in one shuffle, and none gather under a null.
    competes = F.col("reason").isNull() & F.col("event_id").isNotNull()
    rivals = Window.partitionBy(F.when(competes, F.col("event_id")), F.when(~competes, F.col("__place")))
    place = F.row_number().over(rivals.orderBy(F.desc("__old"), "time", F.xxhash64("value")))
    judged = judged.withColumn("reason", F.coalesce("reason", F.when(place > 1, F.lit(REPEATED))))
    judged = judged.where(~F.col("__old")).drop("__place", "__old")
    judged.write.mode("overwrite").parquet(batch_path(f"{path}-rows", batch_id))

    good = spark.read.parquet(batch_path(f"{path}-rows", batch_id)).where(F.col("reason").isNull())
    counts = _counted(with_reward(good))
    counts.write.mode("overwrite").parquet(batch_path(f"{path}-counts", batch_id))
    merge_batches(spark, f"{path}-counts", _summed)
    # Last, as it tells the following batches that this one is whole.
    last = good.agg(F.max("time").alias("last")).withColumn("learnt_in", F.lit(batch_id))
    last.coalesce(1).write.mode("overwrite").parquet(batch_path(f"{path}-times", batch_id))
    merge_batches(spark, f"{path}-times", lambda rows: rows)


def stream_feedback(messages: DataFrame, path: str, delay: str = "30 DAYS") -> tuple[DataFrame, DataFrame]:
    """Learn from a stream of messages and keep those that can't be learnt from.

    Returns the posterior, and the rejected messages with their ``reason`` and the columns they came
    with (the partition and offset of a topic, say). Messages need ``value``; ``event_id``, where the
    sender gives one, makes repeats count once.
    """
    run_batches(messages, path, "append", lambda batch, batch_id: learn_batch(batch, batch_id, path, delay))
    return feedback_results(messages.sparkSession, path, messages.columns)


def feedback_results(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """What :func:`stream_feedback` has come to: the posterior, and the rejected messages."""
    posterior = posterior_from_counts(_summed(read_batches(spark, f"{path}-counts")))
    rejected = spark.read.parquet(f"{path}-rows").where(F.col("reason").isNotNull())
    return posterior, rejected.select("batch_id", *columns, "reason")


def pinned_posterior(spark: SparkSession, posterior_path: str, pins: str, batch_id: int) -> DataFrame:
    """The posterior that a micro-batch decides with: the newest when the batch is first tried, stored
    beside its results, so that a batch that is tried again decides alike."""
    if batch_id not in batch_ids(spark, pins):
        newest_batch(spark, posterior_path).coalesce(1).write.mode("overwrite").parquet(batch_path(pins, batch_id))
    return spark.read.parquet(batch_path(pins, batch_id))


def decide_batch(
    states: DataFrame, batch_id: int, posterior_path: str, path: str, profile: str = "declared"
) -> DataFrame:
    """Recommendations of one micro-batch, with the posterior pinned to it."""
    missing = {"consecutive_high_days"} - set(states.columns) if profile == "declared" else set()
    if missing:
        raise ValueError(f"states lack {', '.join(sorted(missing))}, which a limit of the profile {profile} needs")
    posterior = pinned_posterior(states.sparkSession, posterior_path, f"{path}-posteriors", batch_id)
    return recommend(states, lambda s: greedy(s, posterior), profile)


def stream_recommendations(states: DataFrame, posterior_path: str, path: str, profile: str = "declared") -> DataFrame:
    """Recommend for every arriving state with the posterior stored before its micro-batch."""
    write_batches(states, path, "append", lambda batch, n: decide_batch(batch, n, posterior_path, path, profile))
    return states.sparkSession.read.parquet(path).drop("batch_id")


def stream_routes(events: DataFrame, path: str) -> DataFrame:
    """Route events to topics. With a Kafka connector the same columns feed its sink."""
    append_available(route_events(events), path)
    return events.sparkSession.read.parquet(path)


def stream_alerts(states: DataFrame, path: str) -> DataFrame:
    """Alerts for unsafe states as they arrive."""
    append_available(safety_alerts(assess(states)), path)
    return states.sparkSession.read.parquet(path)


def stream_daily(records: DataFrame, path: str, event_id: str = "event_id", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Daily measures from a record stream; records later than ``delay`` are left out and counted.

    Changed days are written per micro-batch; the newest row of a day is its value. Each run adds
    the number of late records to a table, see :func:`late_records`.
    """
    unique = records.withWatermark(time, delay).dropDuplicatesWithinWatermark([event_id])
    days = unique.withColumn("date", F.window(time, "1 day"))
    daily = daily_measures(days).withColumn("date", F.to_date("date.start"))
    keys = ["user_id", "date"]
    late = write_batches(daily, path, "update", merge=newest_per_key(keys))
    spark = records.sparkSession
    spark.createDataFrame([(late,)], "late long").write.mode("append").parquet(f"{path}-late")
    return newest_rows(spark, path, keys)


def late_records(spark: SparkSession, path: str) -> DataFrame:
    """``late long``: how many records all runs of :func:`stream_daily` found behind the watermark."""
    return spark.read.parquet(f"{path}-late").agg(F.sum("late").alias("late"))
