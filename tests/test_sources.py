"""Readers and writers over small files written by hand."""

import datetime as dt
import json

from pyspark.sql import functions as F

from pulseframe.sources import files, health_xml, oura, sinks

EXPORT = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE HealthData [ <!ELEMENT Record (MetadataEntry*)> ]>
<HealthData locale="en">
 <ExportDate value="2024-01-03 00:00:00 -0500"/>
 <Record type="HKQuantityTypeIdentifierHeartRate" sourceName="Tom&apos;s &quot;Watch&quot;" startDate="2024-01-01 23:30:00 -0500" endDate="2024-01-01 23:30:00 -0500" value="72">
  <MetadataEntry key="k" value="v"/>
 </Record>
 <Record type="HKQuantityTypeIdentifierRestingHeartRate" sourceName='a > b' startDate="2024-01-01 01:00:00 +0000" endDate="2024-01-01 01:00:00 +0000" value="n/a"/>
 <Record type="HKQuantityTypeIdentifierBodyMass" sourceName="s" startDate="2024-01-01 01:00:00 +0000" endDate="2024-01-01 01:00:00 +0000" value="70"/><Record
   type="HKCategoryTypeIdentifierSleepAnalysis" sourceName="s" startDate="2024-01-01 22:00:00 +0000" endDate="2024-01-02 05:30:00 +0000" value="asleep"/>
 <Record type="HKWorkoutTypeIdentifier" sourceName="s" startDate="2024-01-01 08:00:00 +0100" endDate="2024-01-01 07:45:00 +0000" value="1"/>
 <Record type="HKQuantityTypeIdentifierHeartRateVariabilitySDNN" sourceName="s" startDate="someday" value="41.5"/>
</HealthData>
"""


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def export(spark, tmp_path):
    return health_xml.scan_health_xml(spark, write(tmp_path / "export.xml", EXPORT)).collect()


def test_split_xml_reader(spark, tmp_path):
    path = write(tmp_path / "export.xml", EXPORT)
    rows = health_xml.scan_health_xml(spark, path).collect()
    assert [r.type for r in rows] == [
        "heart_rate", "resting_heart_rate", "HKQuantityTypeIdentifierBodyMass", "sleep", "workout", "hrv",
    ]
    assert rows[0].source == "Tom's \"Watch\"" and rows[1].source == "a > b"
    assert rows[5].end_date is None


def test_split_reader_equals_document_reader(spark, tmp_path):
    path = write(tmp_path / "export.xml", EXPORT)
    split = sorted(map(str, health_xml.scan_health_xml(spark, path).collect()))
    assert split == sorted(map(str, health_xml.scan_health_xml_documents(spark, path).collect()))


def test_one_export_is_read_by_several_tasks(spark, tmp_path):
    record = '<Record type="HKQuantityTypeIdentifierStepCount" sourceName="s" startDate="2024-01-01 01:00:00 +0000" value="{}"/>\n'
    path = write(tmp_path / "big.xml", "<HealthData>\n" + "".join(record.format(i) for i in range(5000)) + "</HealthData>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = health_xml.scan_health_xml(spark, path)
        assert df.rdd.getNumPartitions() > 4
        assert sorted(int(r.value) for r in df.collect()) == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_typed_views(spark, tmp_path):
    views = health_xml.all_views(health_xml.scan_health_xml(spark, write(tmp_path / "e.xml", EXPORT)))
    hr = views["heart_rate"].collect()
    assert [r.value for r in hr] == [72.0, None]
    assert hr[0].date == dt.date(2024, 1, 1)
    assert views["sleep"].first().duration == 7.5
    assert views["workouts"].first().duration == 45.0
    hrv = views["hrv"].first()
    assert (hrv.value, hrv.start_date, hrv.date) == (41.5, None, None)
    assert views["activity"].count() == 0


def test_empty_views_are_not_written(spark, tmp_path):
    views = health_xml.all_views(health_xml.scan_health_xml(spark, write(tmp_path / "e.xml", EXPORT)))
    written = sinks.write_views(views, str(tmp_path / "out"), "apple_health")
    assert [p.rsplit("_", 1)[-1] for p in written] == ["rate", "sleep", "workouts", "hrv"]


def test_trends_with_different_headers(spark, tmp_path):
    a = write(tmp_path / "a.csv", "date,Steps,Readiness Score,Other\n2024-01-01,100,88,x\n")
    b = write(tmp_path / "b.csv", "Readiness Score,date,Total Sleep Duration\nbad,2024-01-02T00:00:00,7200\n")
    rows = oura.scan_oura_trends(spark, [a, b], sleep_divisor=3600).orderBy("date").collect()
    assert (rows[0].steps, rows[0].readiness_score, rows[0].sleep_duration_hours) == (100.0, 88.0, None)
    assert (rows[1].date, rows[1].readiness_score, rows[1].sleep_duration_hours) == (dt.date(2024, 1, 2), None, 2.0)
    assert "Other" not in rows[0].asDict()


def test_payload_documents(spark, tmp_path):
    document = {"data": [{"day": "2024-01-01", "score": 80, "efficiency": 91}, {"day": "2024-01-02"}], "next": None}
    path = write(tmp_path / "sleep.json", json.dumps(document, indent=2))
    rows = oura.scan_oura_payloads(spark, path, "sleep", multi_line=True).orderBy("date").collect()
    assert [(r.date, r.sleep_score, r.sleep_efficiency) for r in rows] == [("2024-01-01", 80.0, 91.0), ("2024-01-02", None, None)]
    assert len(rows[0]) == 11


def test_participants(spark, tmp_path):
    for who in ("p01", "p02", "other"):
        write(tmp_path / who / "fitbit" / "sleep_score.csv", "timestamp,overall_score\n2024-01-01T23:30:00Z,80\n")
        write(tmp_path / who / "fitbit" / "exercise.csv", "timestamp,overall_score\n2024-01-01T23:30:00Z,99\n")
    rows = files.scan_participants(spark, str(tmp_path)).orderBy("user_id").collect()
    assert [(r.user_id, r.date, r.overall_score) for r in rows] == [
        ("p01", dt.date(2024, 1, 1), 80.0), ("p02", dt.date(2024, 1, 1), 80.0),
    ]


def test_history_csv_defaults_and_truncation(spark, tmp_path):
    path = write(tmp_path / "h.csv", "readiness_score,hrv\n85.9,-3.7\nbad,50\n")
    rows = files.import_history_csv(spark, path).collect()
    assert [(r.readiness_score, r.hrv, r.sleep_score, r.fatigue, r.workout_type, r.source) for r in rows] == [
        (85, -3, 80, 5, "Unknown", "csv_upload"), (None, 50, 80, 5, "Unknown", "csv_upload"),
    ]


def test_history_json_array_and_object(spark, tmp_path):
    schema = "timestamp double, state struct<fatigue: int>"
    many = write(tmp_path / "a.json", json.dumps([{"timestamp": 1, "state": {"fatigue": 3}}, {"timestamp": 2}], indent=1))
    one = write(tmp_path / "b.json", json.dumps({"timestamp": 3}, indent=1))
    read = lambda p: files.import_history_json(spark, p, schema, multi_line=True)
    assert sorted(r.timestamp for r in read(many).unionByName(read(one)).collect()) == [1, 2, 3]


def test_sessions_append(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 6, [("Squat", 3, None), (None, None, 40.0)])],
        "user_id int, fatigue int, exercises array<struct<exercise_name: string, sets: int, weight_kg: double>>",
    )
    path = str(tmp_path / "log")
    sinks.append_sessions(df, path)
    sinks.append_sessions(df, path)
    rows = spark.read.parquet(path).orderBy("exercise_name").collect()
    assert len(rows) == 4
    assert (rows[0].exercise_name, rows[0].sets, rows[0].weight_kg, rows[0].reps, rows[0].rest_seconds) == ("", 0, 40.0, 0, 60)
    assert (rows[2].exercise_name, rows[2].fatigue, rows[2].weight_kg) == ("Squat", 6, 0.0)


def test_upsert_keeps_other_days_and_users(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "user_id int, date date, created_at int, x int")
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    path = str(tmp_path / "states")
    sinks.upsert_states(make([(1, d1, 1, 10), (1, d1, 2, 11), (2, d1, 1, 20), (1, d2, 1, 30)]), path)
    sinks.upsert_states(make([(1, d1, 5, 12), (2, d1, 0, 99)]), path)
    rows = spark.read.parquet(path).collect()
    assert {(r.user_id, r.date): r.x for r in rows} == {(1, d1): 12, (2, d1): 20, (1, d2): 30}
    assert len(rows) == 3


def test_snapshot_versions(spark, tmp_path):
    path = str(tmp_path / "posterior")
    make = lambda a: spark.createDataFrame([(0, a)], "action_id int, alpha double")
    sinks.write_snapshot(make(1.0), path, dt.date(2024, 1, 1))
    sinks.write_snapshot(make(2.0), path, dt.date(2024, 1, 5))
    sinks.write_snapshot(make(3.0), path, dt.date(2024, 1, 5))
    assert sinks.read_snapshot(spark, path).first().alpha == 3.0
    assert sinks.read_snapshot(spark, path, dt.date(2024, 1, 4)).first().alpha == 1.0


def test_routes(spark):
    kinds = ["training.plan.adjusted", "agent.user.feedback", "agent.daily_summary", "feedback_received", "x"]
    df = spark.createDataFrame([(k, 1, "t") for k in kinds], "event_type string, user_id int, timestamp string")
    rows = sinks.route_events(df.withColumn("payload", F.struct("user_id"))).collect()
    assert [r.topic.split(".")[1] for r in rows] == ["plan", "user", "conversation", "conversation", "conversation"]
    assert [r.loop_topic.split(".")[1] for r in rows] == ["plan", "user", "plan", "user", "plan"]
    assert json.loads(rows[0].value)["payload"] == {"user_id": 1}


def test_monthly_files_are_few(spark, tmp_path):
    days = spark.range(200).select(F.col("id"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 60).cast("int")).alias("date"))
    path = str(tmp_path / "monthly")
    sinks.write_monthly(days.repartition(20), path)
    assert len(list((tmp_path / "monthly").glob("year_month=*/*.parquet"))) <= 6
    assert spark.read.parquet(path).where("year_month = '2024-02'").count() == days.where("month(date) = 2").count()


def test_training_log(spark, tmp_path):
    names = [c.split()[0] for c in files.TRAINING_LOG.split(", ")]
    row = "2024-01-01 10:30:00,Bench Press,4,8,80,60,8,6,8,,strong,Push,60"
    path = write(tmp_path / "log.csv", ",".join(names) + "\n" + row + "\n")
    got = files.scan_training_log(spark, path).first()
    assert (got.date, got.exercise_name, got.weight_kg, got.muscle_soreness, got.total_duration_minutes) == (
        dt.datetime(2024, 1, 1, 10, 30), "Bench Press", 80.0, None, 60,
    )


def test_csv_files_are_read_by_name(spark, tmp_path):
    write(tmp_path / "h" / "a.csv", "readiness_score,hrv\n90,40\n")
    write(tmp_path / "h" / "b.csv", "hrv,readiness_score,workout_type\n41,91,Run\n")
    rows = files.import_history_csv(spark, str(tmp_path / "h")).orderBy("hrv").collect()
    assert [(r.readiness_score, r.hrv, r.workout_type) for r in rows] == [(90, 40, None), (91, 41, "Run")]
    write(tmp_path / "r" / "p01" / "fitbit" / "sleep_score.csv", "timestamp,overall_score,deep\n2024-01-01T00:00:00Z,70,50\n")
    write(tmp_path / "r" / "p02" / "fitbit" / "sleep_score.csv", "timestamp,deep,overall_score\n2024-01-01T00:00:00Z,51,71\n")
    rows = files.scan_participants(spark, str(tmp_path / "r")).orderBy("user_id").collect()
    assert [(r.user_id, r.overall_score, r.deep) for r in rows] == [("p01", 70.0, 50.0), ("p02", 71.0, 51.0)]
    write(tmp_path / "log.csv", "reps,date,exercise_name\n5,2024-01-01 10:00:00,Squat\nmany,2024-01-02 10:00:00,Row\n")
    rows = files.scan_training_log(spark, str(tmp_path / "log.csv")).orderBy("date").collect()
    assert [(r.reps, r.exercise_name, r.sets) for r in rows] == [(5, "Squat", None), (None, "Row", None)]


def test_long_tail_and_malformed_records(spark, tmp_path):
    good = '<Record type="HKQuantityTypeIdentifierStepCount" sourceName="s" startDate="x" value="{}"/>\n'
    tail = "".join(f'<Workout n="{i}"/>\n' for i in range(20_000))
    path = write(tmp_path / "e.xml", "<HealthData>\n" + good.format(1) + "<Record type=broken/>\n" + good.format(2) + tail + "</HealthData>")
    assert [r.value for r in health_xml.scan_health_xml(spark, path).collect()] == ["1", "2"]
    assert [r.piece.strip() for r in health_xml.quarantined_records(spark, path).collect()] == ["<Record type=broken/>"]
    longest = health_xml._record_pieces(spark, path).agg(F.max(F.length("value"))).first()[0]
    assert longest < 200


def test_upsert_reads_touched_days_and_keeps_rows_on_faults(spark, tmp_path):
    path = str(tmp_path / "states")
    schema = "user_id bigint, hrv int, created_at int, date date"
    day = dt.date(2024, 1, 1)
    sinks.upsert_states(spark.createDataFrame([(1, 40, 1, day), (2, 50, 1, day)], schema), path)
    sinks.upsert_states(spark.createDataFrame([(1, 41, 2, day)], schema), path)
    rows = spark.read.parquet(path).orderBy("user_id").collect()
    assert [(r.user_id, r.hrv) for r in rows] == [(1, 41), (2, 50)]
    broken = tmp_path / "broken"
    broken.mkdir()
    import pytest
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        sinks.upsert_states(spark.createDataFrame([(1, 41, 2, day)], schema), str(broken))
