"""Run registered queries next to their SQL oracles and compare whole results.

    python -m tests.oracle_check [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("set timezone='UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{Path(sf_dir) / name}.parquet'")
    return connection


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (0, "") if math.isnan(value) else (1, float(value))
    return (1, int(value)) if isinstance(value, (bool, int)) else (2, str(value))


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, connection, query, sql: str, sf_dir: str) -> str | None:
    """None when the results are equal, else a short account."""
    frame = query(spark, sf_dir)
    got_names, got = frame.columns, frame.collect()
    cursor = connection.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    got_rows, want_rows = _rows(got_names, got), _rows(want_names, want)
    if len(got_rows) != len(want_rows):
        return f"{len(got_rows)} rows != {len(want_rows)}"
    bad = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first: {str(bad[0][0])[:600]} != {str(bad[0][1])[:600]}"
    return None if got_rows else "no rows to compare"


def main() -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    connection, oracles, failed = duck(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.perf_counter()
        try:
            if name in oracles:
                problem = differences(spark, connection, query, oracles[name], sf_dir)
            else:
                problem = None if query(spark, sf_dir).collect() else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.perf_counter() - began:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
