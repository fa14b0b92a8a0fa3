"""Run registered queries beside their SQL twins: ``python tests/compare.py FOLDER [name…]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        if isinstance(value, float) and (math.isnan(value) or math.isinf(value)):
            return str(value)
        return round(float(value), 9) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return str(value)


def normalised(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


def check(spark, connection, folder: str, name: str) -> str | None:
    """None if equal, else what differs."""
    import workbook

    frame = workbook.QUERIES[name](spark, folder)
    names, rows = normalised(frame.columns, [tuple(r) for r in frame.collect()])
    sql = workbook.ORACLES.get(name)
    if sql is None:
        return None if rows else "no rows"
    result = connection.execute(sql)
    expected_names, expected = normalised([d[0] for d in result.description], result.fetchall())
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if rows != expected:
        wrong = [(a, b) for a, b in zip(rows, expected) if a != b][:3]
        return f"rows {len(rows)} vs {len(expected)}; first differences {wrong}"
    return None


def main() -> None:
    import workbook
    from tablelens.session import build_session

    workbook.load()
    folder, wanted = sys.argv[1], sys.argv[2:] or list(workbook.QUERIES)
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    connection, failed = duck(folder), []
    for name in wanted:
        started = time.time()
        try:
            problem = check(spark, connection, folder, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        mark = "ok" if problem is None else "FAIL " + problem
        kind = "" if name in workbook.ORACLES else " (rows only)"
        print(f"{name}{kind} {time.time() - started:.1f}s {mark}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
