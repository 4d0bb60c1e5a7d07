"""Rows of a query against the rows of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, decimal.Decimal)) and not isinstance(x, float):
        return int(x) if x == int(x) else float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return in_order(names, found.fetchall())


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    return in_order(df.columns, [tuple(r) for r in df.collect()])


def in_order(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    at = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in at) for r in rows]
    return [names[i] for i in at], sorted(out, key=repr)
