"""HealthKit XML exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.scalars import hours_between, minutes_between, to_instant, to_number, wall_clock_date

# HealthKit identifiers and their short names.
RECORD_TYPES = {
    "HKQuantityTypeIdentifierHeartRate": "heart_rate",
    "HKQuantityTypeIdentifierRestingHeartRate": "resting_heart_rate",
    "HKQuantityTypeIdentifierHeartRateVariabilitySDNN": "hrv",
    "HKQuantityTypeIdentifierStepCount": "steps",
    "HKQuantityTypeIdentifierActiveEnergyBurned": "active_energy",
    "HKQuantityTypeIdentifierBasalEnergyBurned": "basal_energy",
    "HKCategoryTypeIdentifierSleepAnalysis": "sleep",
    "HKWorkoutTypeIdentifier": "workout",
}

# The typed views and the record types in each.
VIEWS = {
    "heart_rate": ("heart_rate", "resting_heart_rate"),
    "activity": ("steps", "active_energy", "basal_energy"),
    "sleep": ("sleep",),
    "workouts": ("workout",),
    "hrv": ("hrv",),
}

ATTRIBUTES = "type string, value string, startDate string, endDate string, sourceName string"
OPENING_TAG = r"""^Record((?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))+)\s*/?>"""


def _records(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.coalesce(_short_name("type"), "type").alias("type"),
        F.col("type").alias("original_type"),
        "value",
        F.col("startDate").alias("start_date"),
        F.col("endDate").alias("end_date"),
        F.col("sourceName").alias("source"),
    )


def _short_name(column: str) -> Column:
    names = F.create_map(*[F.lit(x) for pair in RECORD_TYPES.items() for x in pair])
    return F.try_element_at(names, F.col(column))


def scan_health_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every Record of the exports as six string columns.

    An export is one large file. The text reader splits it at each ``<``, which stands in no
    attribute and no text, so one export is read by many tasks and no row is longer than a tag
    with the text behind it. The XML parser then sees one opening tag at a time, which holds
    all attributes. Records that don't parse are left to :func:`quarantined_records`.
    """
    pieces = _record_pieces(spark, path)
    tag = F.nullif(F.regexp_extract("value", OPENING_TAG, 1), F.lit(""))
    element = F.concat(F.lit("<Record"), tag, F.lit("/>"))
    record = F.from_xml(element, ATTRIBUTES, {"attributePrefix": ""})
    # A generator parses once; a filter on the parsed record would parse again below itself.
    return _records(pieces.select(F.inline(F.array_compact(F.array(record)))))


def _record_pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "<").text(path).where(F.col("value").rlike(r"^Record[\s/>]"))


def quarantined_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, piece``: Records of the exports whose opening tag can't be read."""
    pieces = _record_pieces(spark, path).select("value", F.col("_metadata.file_path").alias("file"))
    return pieces.where(~F.col("value").rlike(OPENING_TAG)).select("file", F.concat(F.lit("<"), "value").alias("piece"))


def scan_health_xml_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same through the built-in XML source, which reads each file in one task."""
    raw = (
        spark.read.format("xml")
        .option("rowTag", "Record")
        .option("attributePrefix", "")
        .schema(ATTRIBUTES)
        .load(path)
    )
    return _records(raw)


def typed_view(records: DataFrame, view: str) -> DataFrame:
    """Records of a view with parsed times, and a numeric value or a duration.

    Sleep gets hours and workouts minutes; the other views get a number. ``date`` is the
    wearer's calendar date.
    """
    chosen = records.where(F.col("type").isin(*VIEWS[view])).withColumn("date", wall_clock_date("start_date"))
    start = to_instant("start_date")
    if view in ("sleep", "workouts"):
        timed = chosen.withColumns({"start_date": start, "end_date": to_instant("end_date")})
        between = hours_between if view == "sleep" else minutes_between
        return timed.withColumn("duration", between("start_date", "end_date"))
    return chosen.withColumns({"value": to_number("value"), "start_date": start})


def all_views(records: DataFrame) -> dict[str, DataFrame]:
    return {view: typed_view(records, view) for view in VIEWS}


def measurable(records: DataFrame) -> DataFrame:
    """All records with date, number and duration in hours, ready for the daily aggregates."""
    return records.withColumns(
        {
            "date": wall_clock_date("start_date"),
            "value": to_number("value"),
            "duration": hours_between(to_instant("start_date"), to_instant("end_date")),
        }
    )
