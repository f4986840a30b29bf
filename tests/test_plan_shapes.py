"""Physical plans: what must and must not be in them."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from pulseframe.operators import daily as dy
from pulseframe.operators import features as ft
from pulseframe.operators import history as hi
from pulseframe.operators import policy as po
from pulseframe.operators import posterior as pt
from pulseframe.operators import quality as ql
from pulseframe.operators import safety as sf
from pulseframe.operators.reward import with_reward
from pulseframe.plans.inputs import source

PANDAS = {"linear_expected_reward", "linear_thompson_decision", "thompson_decision"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(queries()))
def test_no_pair_joins_python_rows_or_global_windows(spark, folder, name):
    text = plan(queries()[name](spark, folder))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text
    if name not in PANDAS:
        assert "InPandas" not in text
    for line in text.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not re.search(r"\], \[\](, \[|$)", line.strip()), line


def test_features_shuffle_and_sort_once(spark, folder, tmp_path):
    source(spark, folder, "day").write.parquet(str(tmp_path / "day"))
    text = plan(ft.daily_features(spark.read.parquet(str(tmp_path / "day"))))
    assert text.count("Exchange hashpartitioning(user_id") == 1 and text.count("Exchange") == 1
    assert text.count("Sort [") == 1


def test_daily_measures_shuffle_once_after_partial_aggregation(spark, folder):
    text = plan(dy.daily_measures(source(spark, folder, "records"), "value"))
    assert text.count("Exchange") == 1 and "partial_avg" in text


def test_two_source_alignment_joins_without_further_shuffles(spark, folder):
    apple = dy.daily_measures(source(spark, folder, "apple_records"), "value")
    text = plan(dy.unify({"oura": source(spark, folder, "oura_day"), "apple": apple}))
    assert text.count("Exchange hashpartitioning") == 2


def test_decisions_do_not_shuffle_the_states(spark, folder, tmp_path):
    ft.with_high_load_days(source(spark, folder, "states")).write.parquet(str(tmp_path / "states"))
    states = spark.read.parquet(str(tmp_path / "states"))
    posterior = pt.beta_posterior(with_reward(source(spark, folder, "fb")))
    text = plan(po.recommend(states, lambda s: po.greedy(s, posterior)))
    main = text[text.rindex("Subquery") :] if "Subquery" in text else text
    assert "BroadcastHashJoin" in text
    states_branch = main.split("FileScan parquet")[-2] if main.count("FileScan parquet") > 1 else main
    assert "hashpartitioning(user_id" not in states_branch


def test_latest_and_last_n_limit_before_the_shuffle(spark, folder):
    records = source(spark, folder, "records")
    for df in (ql.latest_per_key(records, ["user_id", "date"], ["event_id"]), hi.last_n(records, 7, ["event_id"])):
        text = plan(df)
        assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_scans_read_only_what_is_used(spark, folder):
    text = plan(queries()["source_profile"](spark, folder))
    assert "raw_value" not in text
    for columns in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert "props" not in columns


def test_filters_reach_the_scan(spark, folder):
    df = sf.safety_alerts(sf.assess(source(spark, folder, "states")))
    assert "Filter" in plan(df)
    recent = plan(queries()["recent_sessions"](spark, folder))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", recent)


def test_posterior_is_reduced_before_its_shuffle(spark, folder):
    text = plan(pt.beta_posterior(with_reward(source(spark, folder, "fb")).where(F.col("action_id") >= 0)))
    assert "partial_sum" in text


def test_sampling_keeps_the_model_out_of_the_rows(spark, folder):
    """A model attached as a column of every row would be copied per row."""
    for name, attached in (("thompson_decision", "_grids#"), ("linear_thompson_decision", "_model#")):
        assert attached not in plan(queries()[name](spark, folder))
