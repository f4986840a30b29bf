"""Tables between the steps of an operator go when a pipeline's stage is written."""

import os

import pytest

import corpus_pipeline
from pulseframe.llm.components import passing_tables, saved
from pulseframe.session import shared_folder

SMALL = "/root/testdata/sf0.001"


def tables(spark):
    top = f"{shared_folder(spark)}/pulseframe/{spark.sparkContext.applicationId}"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_tables_of_a_block_go_at_its_end(spark):
    rows = spark.range(3)
    before = tables(spark)
    stays = saved(spark, rows, "stays")
    with pytest.raises(ValueError, match="in between"), passing_tables(spark):
        saved(spark, rows, "outer")
        with passing_tables(spark):
            saved(spark, rows, "inner")
        assert {t.split("-")[0] for t in tables(spark) - before} == {"stays", "outer"}
        raise ValueError("in between")
    assert {t.split("-")[0] for t in tables(spark) - before} == {"stays"} and stays.count() == 3


def test_a_pipeline_leaves_its_result_alone(spark):
    before = tables(spark)
    packed = corpus_pipeline.run(spark, SMALL)
    left = tables(spark) - before
    assert len(left) == 1 and packed.count() > 0
