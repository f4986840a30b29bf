"""Run registered queries against their SQL in DuckDB and compare rows.

Usage: python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: tuple((v is None, str(type(v).__name__), str(v)) for v in row)
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=key)


def differences(df, con, sql: str) -> str | None:
    """None when rows, column names and broad types agree, otherwise what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected_rows = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    actual = normal(df.columns, [tuple(r) for r in df.collect()])
    expected = normal(names, expected_rows)
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected, strict=True) if a != e]
    if wrong:
        return f"{len(wrong)} of {len(actual)} rows differ; columns {sorted(names)}; first {wrong[0]}"
    types = dict(zip(names, [str(d[1]) for d in result.description], strict=True))
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    }
    off = {c: (t, types[c]) for c, t in spark_types.items() if same.get(t) != types[c]}
    return f"types {off}" if off else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from pulseframe.session import get_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(queries())
    spark = get_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__ui__showConsoleProgress="false",
                        spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    for name in wanted:
        start = time.time()
        try:
            df = queries()[name](spark, folder)
            sql = oracle_sql().get(name)
            problem = differences(df, con, sql) if sql else None
            note = f"rows {df.count()}" if not sql else ""
        except Exception as error:
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {note} {problem or ''}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
