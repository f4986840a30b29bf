"""The registered decontamination query on a benchmark with items of fewer words than a window, against its SQL."""

import random

import duckdb
from compare import differences
from pyspark.sql import functions as F

from pulseframe.llm import decontamination, queries


def test_items_shorter_than_a_window(spark, tmp_path):
    pick = random.Random(8)
    word = lambda: "".join(pick.choices("abcdé", k=pick.randint(1, 3)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    items = [(1, "Zwölf"), (2, "two words"), (3, sentence(9)), (4, sentence(10)), (5, sentence(30)), (6, "a"), (7, ""), (8, None)]
    # An accented capital is no lower-case letter by the contract: it stays as it is.
    docs = [(100, "ZwöLF, zwÖlf! " + sentence(5)), (101, "TWO  words two-words"), (102, None), (103, "")]
    for i in range(80):
        planted = pick.choice([t for _, t in items if t])
        docs.append((i, " ".join([sentence(pick.randint(0, 60)), planted, sentence(pick.randint(0, 60))])))
    docs += [(200, "x " * 8 + items[2][1]), (201, items[2][1] + " "), (202, " ".join(items[4][1].split()[3:14])), (203, items[4][1] * 40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    found = queries.QUERIES["op10_benchmark_decontamination"](spark, str(tmp_path))
    assert differences(found, duck, queries.ORACLES["op10_benchmark_decontamination"]) is None
    assert found.where("n_items > 0").count() > 40


def test_lowering_leaves_other_letters_alone(spark):
    texts = ["ABC déf", "ÀB ẞ İx Ǆ ǅ ÉTÉ", "straße", "x́Yͅ", "ŉ ﬁ ß", "Ⅷ ⓐⒶ", "\U00010400A"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.array_remove(F.split(F.translate("text", decontamination.UPPER, decontamination.UPPER.lower()), decontamination.BETWEEN), "")
    assert rows.where(decontamination.words(F.col("text")) != plain).count() == 0


def test_plan_reads_texts_once_and_runs_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    plan = decontamination.decontaminate(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "MapIn" not in plan
    optimized = decontamination.decontaminate(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("doc_id") <= 4  # one scan: the texts are not read again to count words
