"""Running a query's SQL in DuckDB and comparing rows."""

from __future__ import annotations

import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(normal(x) for x in v)
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(df) -> Counter:
    columns = sorted(df.columns)
    return Counter(tuple(normal(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(sf: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    result = con.sql(sql)
    order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    return [result.columns[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in result.fetchall())
