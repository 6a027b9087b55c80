"""Compare a query with its DuckDB oracle: rows, schema, values in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


def differences(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if both agree, else what differs first."""
    names = sorted(df.columns)
    want = con.sql(sql)
    if names != sorted(want.columns):
        return f"columns {names} against {sorted(want.columns)}"
    kinds = dict(zip(want.columns, map(str, want.types)))
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    for name, kind in df.dtypes:
        if kind in same and same[kind] != kinds[name]:
            return f"type of {name}: {kind} against {kinds[name]}"
    key = lambda row: tuple((v is None, str(type(v)), str(v)) for v in row)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=key)
    rows = want.project(", ".join(f'"{n}"' for n in names)).fetchall()
    rows = sorted((tuple(map(_plain, r)) for r in rows), key=key)
    if len(got) != len(rows):
        return f"{len(got)} rows against {len(rows)}: {sorted(set(got) ^ set(rows), key=key)[:4]}"
    return next((f"{names}: {a} against {b}" for a, b in zip(got, rows) if a != b), "")
