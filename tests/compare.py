"""Compare named queries with their SQL twins: ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def plain(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return None if math.isnan(number) else number
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def rows_of(names: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    values = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(values, key=repr)


def difference(spark, connection, folder: str, name: str, query, sql: str) -> str | None:
    """None when both give the same rows, else a short description."""
    frame = query(spark, folder)
    ours = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    result = connection.execute(sql)
    theirs = rows_of([item[0] for item in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"{name}: columns {set(ours[0]) ^ set(theirs[0])}"
    if len(ours[1]) != len(theirs[1]):
        return f"{name}: {len(ours[1])} rows, twin has {len(theirs[1])}"
    if not ours[1]:
        return f"{name}: no rows"
    for mine, other in zip(ours[1], theirs[1], strict=True):
        if mine != other:
            cells = [(c, a, b) for c, a, b in zip(ours[0], mine, other, strict=True) if a != b]
            return f"{name}: {cells[:3]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from stockrisk.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracle = connect(folder), entry.oracle_sql()
    wanted = sys.argv[2:]
    failed = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = difference(spark, connection, folder, name, query, oracle[name])
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{name}: {type(error).__name__} {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
