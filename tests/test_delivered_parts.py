"""Feedback lands in parts: each is written by several tasks and is one micro-batch all the same."""

import glob

import pytest
from compare import connect, differences

from __spark_entry__ import oracle_sql, queries
from pulseframe.plans import streams
from pulseframe.session import shared_folder


@pytest.fixture
def several_partitions(spark):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_a_part_is_many_files_and_one_batch(spark, folder, tmp_path, several_partitions):
    for file in glob.glob(f"{folder}/*.parquet"):
        (tmp_path / file.rsplit("/", 1)[1]).symlink_to(file)
    pattern = f"{shared_folder(spark)}/pulseframe/*/feedback-messages-*"
    known = set(glob.glob(pattern))
    letters = queries()["stream_dead_letters"](spark, str(tmp_path))
    duck = connect(folder)
    assert differences(letters, duck, oracle_sql()["stream_dead_letters"]) is None
    assert differences(queries()["stream_feedback_messages"](spark, str(tmp_path)), duck, oracle_sql()["stream_feedback_messages"]) is None
    assert {r.batch_id for r in letters.collect()} == {0, 1, 2}
    (landed,) = set(glob.glob(pattern)) - known
    assert len(glob.glob(f"{landed}/part-*")) >= 12


def test_parts_of_late_events_are_as_many_files_each(spark, folder, tmp_path, monkeypatch):
    for file in glob.glob(f"{folder}/*.parquet"):
        (tmp_path / file.rsplit("/", 1)[1]).symlink_to(file)
    monkeypatch.setattr(streams, "EVENTS_PER_FILE", 300)
    monkeypatch.setattr(streams, "LEAST_PER_FILE", 5)
    known = set(glob.glob(f"{shared_folder(spark)}/pulseframe/*/events-late-*"))
    late = queries()["stream_daily_late"](spark, str(tmp_path))
    assert differences(late, connect(folder), oracle_sql()["stream_daily_late"]) is None
    (landed,) = set(glob.glob(f"{shared_folder(spark)}/pulseframe/*/events-late-*")) - known
    count = len(glob.glob(f"{landed}/part-*"))
    assert count % 3 == 0 and count > 3
