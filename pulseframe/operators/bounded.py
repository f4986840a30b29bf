"""Dense row numbers without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 18
#: Even ranges that the ids of a key are counted in first, at most.
COARSE = 1024


def by_key(rows: DataFrame, key: str, value: Column) -> Column:
    """A value of each key, looked up in a map that is made once from ``rows``, one row per key.

    For keys of which there are few, such as policies: the map goes to every task.
    """
    entries = F.map_from_entries(F.collect_list(F.struct(F.col(key), value.alias("_value"))))
    return F.try_element_at(rows.agg(entries.alias("_values")).scalar(), F.col(key))


def equal_ranges(df: DataFrame, key: str, unique_id: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_range`` and ``_part``: ranges of a key's ids that hold about ``chunk_rows`` rows at most.

    The ids of a key are counted in even ranges between its least and greatest one. A range that
    holds too many is cut into as many even parts, between its own least and greatest id, as its
    rows fill; so ids in a few far clusters are cut inside the clusters. Counts are made where rows
    are read, and only a few per key and task are shuffled; ``df`` itself is not.
    """
    # Whole numbers throughout: ids may be larger than doubles can tell apart.
    spans = df.groupBy(key).agg(
        F.min(unique_id).alias("_low"), F.max(unique_id).alias("_high"), F.least(F.lit(COARSE), F.ceil(4 * F.count(F.lit(1)) / chunk_rows)).alias("_n")
    )
    found = df.withColumn("_span", by_key(spans, key, F.struct("_low", F.expr("(_high - _low) div _n + 1").alias("_width"))))
    ranged = found.withColumn("_range", F.expr(f"(`{unique_id}` - _span._low) div _span._width")).drop("_span")
    counted = ranged.groupBy(key, "_range").agg(
        F.count(F.lit(1)).alias("_rows"), F.min(unique_id).alias("_first"), F.max(unique_id).alias("_last")
    )
    counted = counted.withColumn("_width", F.expr(f"(_last - _first) div ceil(_rows / {chunk_rows}) + 1"))
    # At most COARSE rows per key.
    parted = ranged.join(F.broadcast(counted.select(key, "_range", "_first", "_width")), [key, "_range"])
    return parted.withColumn("_part", F.expr(f"(`{unique_id}` - _first) div _width")).drop("_first", "_width")


def dense_index(df: DataFrame, key: str, unique_id: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the rows of each key, of which there are few, from 0 in the order of a unique integer id.

    A plain window would put a whole key into one task. Rows are numbered within the ranges of
    :func:`equal_ranges` and shifted by the number of rows in the key's earlier ranges.
    """
    chunked = equal_ranges(df, key, unique_id, chunk_rows)
    place = [key, "_range", "_part"]
    earlier = Window.partitionBy(key).orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*place, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(*place).orderBy(unique_id)
    return (
        chunked.withColumn("_rank", F.row_number().over(within))
        .join(offsets, place)
        .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
        .drop("_range", "_part", "_rank", "_offset")
    )
