"""Reading file streams, running them over what is available, and reading results back.

A micro-batch writes its own folder, which a repeated batch replaces. So that readers do not
touch every folder ever written, old batches are merged from time to time into a base: the
rows that a reader would take from them. Readers take the newest base and the batches after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.operators.quality import latest_per_key

#: Batches after the base from which on they are merged into a new one.
MERGE_AFTER = 16

Merge = Callable[[DataFrame], DataFrame]


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a parquet folder or a single parquet file.

    The last letter goes in as a pattern because a plain path must be a folder.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def append_available(stream: DataFrame, path: str) -> None:
    """Run a stateless stream over everything available into a parquet table, exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, path: str, mode: str, write: Callable[[DataFrame, int], None]) -> int:
    """Run a stream over everything available, handing each micro-batch and its id to ``write``.

    Returns how many rows came behind the watermark and were left out, as the progress of the run's
    last micro-batches tells (as many as ``spark.sql.streaming.numRecentProgressUpdates``).
    """
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}-checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def write_batches(
    stream: DataFrame,
    path: str,
    mode: str,
    transform: Callable[[DataFrame, int], DataFrame] = lambda df, batch_id: df,
    merge: Merge | None = None,
) -> int:
    """Run a stream over everything available, one folder per micro-batch; returns the late rows left out.

    A batch that is run again after a failure replaces its own folder. With ``merge``, older
    batches are merged as they become many.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch, batch_id).write.mode("overwrite").parquet(batch_path(path, batch_id))
        if merge is not None:
            merge_batches(stream.sparkSession, path, merge)

    return run_batches(stream, path, mode, write)


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders ``name=<number>`` below a path, in order; one listing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [status.getPath().getName().split("=") for status in files.listStatus(folder)]
    return sorted(int(x[1]) for x in found if x[0] == name and len(x) == 2)


def _complete(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def batch_ids(spark: SparkSession, path: str) -> list[int]:
    """The batches that have written all their rows, in order."""
    return [n for n in _numbered(spark, path, "batch_id") if _complete(spark, batch_path(path, n))]


def _base(spark: SparkSession, path: str) -> int | None:
    """The last batch merged into the newest base that is complete."""
    ids = [n for n in _numbered(spark, f"{path}-base", "upto") if _complete(spark, f"{path}-base/upto={n}")]
    return ids[-1] if ids else None


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Rows of the newest base and of the batches after it, with ``batch_id``; None if there are none.

    ``before`` leaves out a batch and those after it, which a batch does with its own. Merging never
    takes in the newest batch, so the base lies before it.
    """
    base = _base(spark, path)
    tail = [n for n in batch_ids(spark, path) if (base is None or n > base) and (before is None or n < before)]
    parts = [spark.read.parquet(f"{path}-base/upto={base}")] if base is not None else []
    if tail:
        parts.append(spark.read.option("basePath", path).parquet(*[batch_path(path, n) for n in tail]))
    if not parts:
        return None
    typed = [p.withColumn("batch_id", F.col("batch_id").cast("long")) for p in parts]
    return typed[0] if len(typed) == 1 else typed[0].unionByName(typed[1])


def merge_batches(spark: SparkSession, path: str, merge: Merge, after: int | None = None) -> None:
    """Merge all batches but the newest, which may yet run again, into a new base once they are many.

    ``merge`` gets and returns rows with ``batch_id``. Folders that the base before has taken in
    go then; those taken in now stay for readers that have begun.
    """
    base, ids = _base(spark, path), batch_ids(spark, path)
    newer = [n for n in ids if base is None or n > base]
    if len(newer) <= (MERGE_AFTER if after is None else after):
        return
    rows = read_batches(spark, path, before=newer[-1])
    merge(rows).write.mode("overwrite").parquet(f"{path}-base/upto={newer[-2]}")
    for n in ids:
        if base is not None and n <= base:
            _remove(spark, batch_path(path, n))
    for n in _numbered(spark, f"{path}-base", "upto"):
        if base is not None and n < base:
            _remove(spark, f"{path}-base/upto={n}")


def newest_per_key(keys: list[str]) -> Merge:
    """Keeps the last version of every key."""
    return lambda rows: latest_per_key(rows, keys, ["batch_id"])


def newest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of every key over the batches of an update-mode stream."""
    return newest_per_key(keys)(read_batches(spark, path)).drop("batch_id")


def newest_only(rows: DataFrame) -> DataFrame:
    """Of a complete-mode stream the last batch holds everything."""
    return rows.where(F.col("batch_id") == rows.select(F.max("batch_id")).scalar())


def newest_batch(spark: SparkSession, path: str) -> DataFrame:
    """The last batch of a complete-mode stream; no other folder is read."""
    return spark.read.parquet(batch_path(path, batch_ids(spark, path)[-1]))
