"""Tables of large values are cut into small row groups, so that readers hold little of them."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pulseframe.llm import suffixes
from pulseframe.llm.components import saved


def test_rows_of_megabytes_get_small_row_groups(spark):
    text = "array_join(transform(sequence(1, 8192), i -> sha2(concat(id, '-', i), 512)), '')"
    rows = spark.range(12, numPartitions=1).select("id", F.expr(f"cast({text} as binary)").alias("blob")).coalesce(1)
    table = saved(spark, rows, "row-groups", suffixes.GROUP_BYTES // 8)
    (path,) = [f.removeprefix("file:/").lstrip("/") for f in table.inputFiles()]
    assert pq.ParquetFile(f"/{path}").metadata.num_row_groups >= 3
    assert table.where("octet_length(blob) > 1000000").count() == 12
