"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
from typing import Any

import duckdb
from pyspark.sql import DataFrame


def plain(x: Any) -> Any:
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if isinstance(x, bytes | bytearray):
        return bytes(x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return float(f"{x:.12g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def sorted_rows(names: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def by_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    return sorted_rows([d[0] for d in got.description], got.fetchall())


def by_spark(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted_rows(df.columns, [tuple(r.asDict(recursive=True).values()) for r in df.collect()])


def same(df: DataFrame, sql: str, sf_dir: str) -> str | None:
    """None if both are equal, else what differs."""
    a, b = by_spark(df), by_sql(sql, sf_dir)
    if a[0] != b[0]:
        return f"columns {a[0]} != {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} != {len(b[1])} rows"
    odd = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(odd)} rows differ, such as {str(odd[0][0])[:400]} != {str(odd[0][1])[:400]}" if odd else None
