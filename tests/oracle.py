"""Side-by-side check of a named query against its SQL."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    as_text = [tuple(_text(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(as_text)


def _text(value) -> str:
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def same(spark_frame, connection, sql: str) -> tuple[bool, str]:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want = canonical(names, result.fetchall())
    got = canonical(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    if want[0] != got[0]:
        return False, f"columns {got[0]} instead of {want[0]}"
    if want[1] != got[1]:
        odd = [pair for pair in zip(got[1], want[1]) if pair[0] != pair[1]][:3]
        return False, f"{len(got[1])} rows instead of {len(want[1])}, first differences {odd}"
    return True, f"{len(got[1])} rows"
