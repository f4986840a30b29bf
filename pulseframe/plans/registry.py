"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.plans.inputs import with_inputs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DECIMALS = 6
# Keeps values with few decimals off the edge of rounding, where the last bit of a sum would show.
NUDGE = 3e-9


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that the order of summation does not show."""
    doubles = {
        f.name: F.round(F.col(f.name) + NUDGE, DECIMALS) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)
    }
    return df.withColumns(doubles) if doubles else df


def _oracle(sql: str, inputs: str, doubles: str, extra: dict[str, str] | None) -> str:
    if doubles:
        places = ", ".join(f"round({c} + {NUDGE}, {DECIMALS}) + 0e0 AS {c}" for c in doubles.split())
        sql = f"SELECT * REPLACE ({places}) FROM ({sql}) q"
    return with_inputs(sql, *inputs.split(), extra=extra)


def query(
    name: str, sql: str | None = None, inputs: str = "", doubles: str = "", extra: dict[str, str] | None = None
) -> Callable[[Query], Query]:
    """Register a query with its DuckDB text. ``inputs`` are the derived inputs the text reads,
    ``doubles`` its floating-point columns, ``extra`` further common table expressions."""

    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, folder: rounded(build(spark, folder))
        if sql is not None:
            ORACLES[name] = _oracle(sql, inputs, doubles, extra)
        return build

    return add
