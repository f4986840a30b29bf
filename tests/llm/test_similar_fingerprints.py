"""Fingerprints name pairs of near copies, beside the bands."""

import random

from pulseframe.llm import similar


def test_fingerprints_name_pairs_without_any_bucket(spark, monkeypatch):
    pick = random.Random(4)
    words = [f"w{pick.randint(0, 500)}" for _ in range(3000)]
    other = " ".join(f"v{pick.randint(0, 500)}" for _ in range(300))
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, other)], "doc_id long, text string")
    buckets = similar.buckets
    monkeypatch.setattr(similar, "buckets", lambda signed: buckets(signed).limit(0))
    assert {r.doc_id for r in similar.one_of_each(spark, docs).collect()} == {1, 3}
