"""Participant directories, training logs, history uploads and plain tables."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions.scalars import to_number, to_whole, wall_clock_date

# Columns of the training log.
TRAINING_LOG = (
    "date timestamp, exercise_name string, sets int, reps int, weight_kg double, rest_seconds int, "
    "rpe int, fatigue int, motivation int, muscle_soreness int, notes string, workout_type string, "
    "total_duration_minutes int"
)

# Columns of a history upload and the value taken when a file lacks the column.
HISTORY_DEFAULTS = {
    "readiness_score": 75,
    "sleep_score": 80,
    "hrv": 50,
    "resting_hr": 60,
    "activity_score": 70,
    "fatigue": 5,
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv_by_name(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files with headers, aligned by column name; a column that a file lacks is null.

    Files that share a header are read together. The headers come from one pass over the first
    block of each file, reduced to one row per file where it is read.
    """
    first = (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        .withColumn("row", F.monotonically_increasing_id())
        .where("start = 0")
        .groupBy("file")
        .agg(F.min_by("value", "row").alias("header"))
    )
    # One row per distinct header; Spark's reader takes the names of its files from the driver.
    by_header = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("files").collect()
    if not by_header:
        return spark.createDataFrame([], T.StructType([]))
    parts = [
        spark.read.option("header", True).option("enforceSchema", False).csv([unquote(f) for f in row["files"]])
        for row in by_header
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_participants(spark: SparkSession, root: str, file: str = "fitbit/sleep_score.csv") -> DataFrame:
    """One file of every participant directory ``p*``; the directory names the user.

    ``timestamp`` stays text and every other column becomes a number.
    """
    raw = read_csv_by_name(spark, f"{root}/p*/{file}")
    inner = file.split("/")[0].replace("*", "[^/]*")
    return raw.select(
        "timestamp",
        *[to_number(F.col(f"`{c}`")).alias(c) for c in raw.columns if c != "timestamp"],
        F.regexp_extract(F.input_file_name(), rf"/(p[^/]*)/{inner}/", 1).alias("user_id"),
        wall_clock_date("timestamp").alias("date"),
    )


def scan_training_log(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """The training log, by the names in its headers; what can't be read as a column's type is null.

    ``extra`` prepends columns, such as ``user_id bigint``. Columns that the log lacks are null.
    """
    raw = read_csv_by_name(spark, path)
    fields = T.StructType.fromDDL(f"{extra}, {TRAINING_LOG}" if extra else TRAINING_LOG)
    return raw.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in fields
        ]
    )


def import_history_csv(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Uploaded history files: whole numbers, defaults for columns that all files lack."""
    raw = read_csv_by_name(spark, path)
    metrics = [
        to_whole(name).alias(name) if name in raw.columns else F.lit(default).alias(name)
        for name, default in HISTORY_DEFAULTS.items()
    ]
    workout = F.col("workout_type") if "workout_type" in raw.columns else F.lit("Unknown").alias("workout_type")
    return raw.select(*keep, *metrics, workout, F.lit("csv_upload").alias("source"))


def import_history_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Uploaded history documents: an array, a single object, or one object per line."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)
