"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.session import scratch_path


#: The tables written within each open block of ``passing_tables``, innermost last.
_passing: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`saved` writes in this block are removed at its end, also if it fails. What is
    made of them must have been written elsewhere by then."""
    paths: list[str] = []
    _passing.append(paths)
    try:
        yield
    finally:
        _passing.remove(paths)
        for path in paths:
            remove_table(spark, path)


def remove_table(spark: SparkSession, path: str) -> None:
    """Remove a table from the shared folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def saved(spark: SparkSession, df: DataFrame, label: str, group_bytes: int | None = None) -> DataFrame:
    """The rows as a table in the shared folder, which cuts lineage and outlives executors.

    Rows of megabytes need ``group_bytes``: pages and row groups are then cut at about that size after
    any row. Otherwise they are after a hundred rows at least, and all that a task has of them is one
    page, which its readers take and unpack as a whole.
    """
    path = scratch_path(spark, label)
    if _passing:
        _passing[-1].append(path)
    sizes = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1} if group_bytes else {}
    df.write.options(**sizes).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``a, root``: the smallest node reachable, for every node that has an edge.

    ``edges`` has two columns ``a, b`` of one orderable type, in any direction; loops and
    nulls are left out and repeats do no harm. Each round links every larger neighbour to
    the smallest one (large star), then every node and its smaller neighbours to their
    smallest (small star), until the edges stay the same; that takes few rounds, and rows
    never outnumber the edges. Each round is written to the shared folder.
    """
    kept = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept = saved(spark, kept, "edges")
    before = None
    while True:
        around = _both_ways(kept)
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(lowest, "a")
        small = small.select("a", F.col("least").alias("b")).unionByName(
            small.where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        )
        kept = saved(spark, small.distinct(), "edges")
        state = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return kept.select("a", F.col("b").alias("root"))
        before = state
